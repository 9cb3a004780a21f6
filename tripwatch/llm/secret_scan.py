"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, passwords in URLs, values of 6 or more characters that are assigned to a credential's name,
and runs of 16 or more letters, digits and + / _ = - (dotted ones as a whole) that have a digit or a high entropy. Their
features are length, kinds of characters and the changes between them, how much is dictionary words, path signs, a known token
format, and the words beside them. The forest is trained from labelled findings; where none are given, from made-up texts that
hold secrets of each kind and what looks like them, placeholders and file names after a credential's name among them.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import chosen, materialise, releasing, row_key

#: Findings to train from, as expected when they are drawn by a hash.
TRAIN_FINDINGS = 20_000
TREES, DEPTH, SEED = 30, 9, 7
#: Times that each kind of example is drawn.
EXAMPLES = 80
#: Characters before a candidate in which neighbouring words are looked for.
BEFORE = 32

#: Least characters of a value after a credential's name, and of a run without one; least entropy of a run without digits.
ASSIGNED, RUN, ENTROPY = 6, 16, 3.0
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{RUN},}}")
_PART = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN},}}")
_NAMES = r"(?:token|secret|passw(?:or)?d|pass[_ -]?(?:phrase|code)|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|secret[_ -]?key|auth|authorization|bearer|credential)s?"
_CREDENTIAL = re.compile(_NAMES + r"[\"']?\s*(?::=|=>|[:=]+|is)?\s*(?:(?:bearer|basic)\s+)?[\"'`]?$", re.I)
_VALUE = r"(?:\"(?P<double>(?:\\.|[^\"\\\n])+)\"|'(?P<single>(?:\\.|[^'\\\n])+)'|`(?P<back>[^`\n]+)`|(?P<bare>(?:(?!</?[A-Za-z])[^\s\"'`])+))"
_ASSIGNED = re.compile(_NAMES + r"[\"']?(?:\s*(?::=|=>|[:=]+)\s*|\s+is\s+|\s+)(?:(?:bearer|basic)\s+)?" + _VALUE, re.I)
#: Some name of a credential has one of these; texts without them need no search.
_HINTS = ("token", "secret", "pass", "pwd", "key", "auth", "bearer", "credential")
_USERINFO = re.compile(r"://[^\s/:@?#\"'<>]*:([^\s/@\"'<>]+)@(?=[A-Za-z0-9\[])")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\s\S])*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\n)*[A-Za-z0-9+/=]{16,})*)")
#: Formats that providers give their tokens.
_KNOWN = re.compile(r"(?:A(?:KIA|SIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.+(?:[\w-]+\.+)*[\w-]+|-----BEGIN [\s\S]*)", re.A)
#: Values after a credential's name that are no values: a word of one kind, code, a placeholder.
_PLAIN = re.compile(r"[A-Z]?(?:[^\W\d_]|['-])*[.,;:!?)]*")
_CODE = re.compile(r"[A-Za-z_][\w.]*[(\[].*|\$[{(].*|\{\{.*|<.*|%\(.*", re.S)
_IDENTIFIER = re.compile(r"(?:sha1|sha256|md5|hash|commit|uuid|guid|digest|checksum|order|invoice|card|phone|isbn|id|number|no\.?)[\"']?\s*[:=#]*\s*[\"']?$", re.I)
_DICTIONARY = "access account admin application base build cache class client config content data date default device document download email error example file function group header home http https image index input item json list login main message model name node number object order output page param password path product public query record release report request response result script server service session setting source static status string style system table target template test text time title type update upload user value version view window".split()
FEATURES = ("length", "digits", "upper", "lower", "hex", "signs", "changes", "pairs", "entropy", "words", "path", "credential", "identifier", "quoted", "known", "plain")

_FINDING = "start long, length long, value_sha256 string, credential boolean, digits_only boolean, known boolean, plain boolean, features array<double>"


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _entropy(value: str) -> float:
    return -sum(k / len(value) * math.log2(k / len(value)) for k in Counter(value).values())


def _features(value: str, before: str, after: str, known: bool, plain: bool) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    pairs = sum(a in "aeiou" and b in "bcdfghjklmnpqrstvwxyz" or b in "aeiou" and a in "bcdfghjklmnpqrstvwxyz" for a, b in zip(value.lower(), value.lower()[1:], strict=False))
    covered = [False] * n
    low = value.lower()
    for w in _DICTIONARY:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = [True] * len(w)
            at = low.find(w, at + 1)
    return [
        float(n), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n, kinds.count(3) / n, changes / n, pairs / n, _entropy(value),
        sum(covered) / n, float(value.count("/") + before.endswith(("/", ".", "\\")) + after.startswith(("/", "."))), float(bool(_CREDENTIAL.search(before))), float(bool(_IDENTIFIER.search(before))), float(before[-1:] in ("\"", "'", "`")), float(known), float(plain),
    ]


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether its place or form makes it a secret) of a text's candidates, in order and apart from one another."""
    spans: list[tuple[int, int, bool]] = []
    if "PRIVATE KEY" in text:
        spans += [(*m.span(), True) for m in _PEM.finditer(text)]
    if "://" in text and "@" in text:
        spans += [(*m.span(1), True) for m in _USERINFO.finditer(text)]
    low = text.lower()
    if any(h in low for h in _HINTS):
        at = 0
        while m := _ASSIGNED.search(text, at):
            kind = m.lastgroup
            start, end = m.span(kind)
            gap = text[m.start() : start]
            at = end
            if kind == "bare":
                # a name before a name ("auth token = x"), or prose: only a sign, "is" or a scheme makes the next word a value
                if not re.search(r"[:=]|\sis\s|(?:bearer|basic)\s", gap, re.I):
                    at = start
                    continue
                end = start + len(text[start:end].rstrip(".,;)]}"))
                more = _ASSIGNED.match(text, start)
                if more:
                    at = start
                    continue
            if end - start >= ASSIGNED:
                spans.append((start, end, False))
    for m in _RUN.finditer(text):
        run = m.group()
        start, end = m.start() + len(run) - len(run.lstrip(".")), m.end() - (len(run) - len(run.rstrip(".")))
        value = text[start:end]
        if (_PART.search(value) or _KNOWN.fullmatch(value)) and (any(c in "0123456789" for c in value) or _entropy(value) >= ENTROPY):
            spans.append((start, end, False))
    out: list[tuple[int, int, bool]] = []
    taken = []
    for start, end, sure in spans:  # the first kinds go first
        at = bisect.bisect(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end))
            out.append((start, end, sure))
    return sorted(out)


def _found(text: str) -> Iterator[dict]:
    for start, end, sure in candidates(text):
        value, before = text[start:end], text[max(0, start - BEFORE) : start]
        quoted = before[-1:] in ("\"", "'", "`")
        known = sure or bool(_KNOWN.fullmatch(value))
        plain = not quoted and not known and bool(_PLAIN.fullmatch(value) and _entropy(value) < 3.5 or _CODE.fullmatch(value))
        own = _features(value, before, text[end : end + 1], known, plain)
        yield {"start": start, "length": len(value), "value_sha256": hashlib.sha256(value.encode()).hexdigest(), "credential": own[11] > 0, "digits_only": value.isdigit(), "known": known, "plain": plain, "features": own}


def findings(docs: DataFrame) -> DataFrame:
    """A row for each candidate of docs: their other columns, and start, length (code points), features and more."""
    names = [c for c in docs.columns if c != "text"]
    schema = StructType([*[docs.schema[c] for c in names], StructField("found", StructType.fromDDL(_FINDING))])
    ready = docs.select(*names, F.col("text").cast("string").alias("text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("value_sha256", pa.string()), ("credential", pa.bool_()), ("digits_only", pa.bool_()), ("known", pa.bool_()), ("plain", pa.bool_()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, found = [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                for own in _found(text or ""):
                    at.append(i)
                    found.append(own)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[rows.column(c).take(index) for c in names], pa.array(found, kind)], names=[*names, "found"])

    return ready.mapInArrow(releasing(run), schema).select(*names, "found.*")


def examples(seed: int = SEED, times: int = EXAMPLES) -> list[tuple[float, str, str, bool, list[float]]]:
    """Labelled findings of made-up texts: (label, text, value, what the plain rule says, features). A finding that overlaps the
    text's secret has label 1, any other one 0; the label comes from how the text was made, not from a feature."""
    draw = random.Random(seed)
    some = lambda signs, n: "".join(draw.choice(signs) for _ in range(n))
    low, hexa, plain = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits
    # half of the words are unknown to the dictionary
    word = lambda: draw.choice(_DICTIONARY) if draw.random() < 0.5 else "".join(draw.choice("bcdfghklmnprstvw") + draw.choice("aeiou") + draw.choice(["", "", "n", "r", "s", "t"]) for _ in range(draw.randint(1, 3)))
    out = []
    for _ in range(times):
        n = draw.randint(6, 40)
        name, sign = draw.choice(("password", "api_key", "token", "secret", "passphrase", "auth_token", "client_secret", "Authorization")), draw.choice(("=", ": ", " = "))
        # secrets at {}
        values = [some(plain + "!@#$%^&*.:-_", n), some(plain, n), some(string.ascii_letters, max(n, 16)), some(hexa, draw.choice((32, 40, 64))), "-".join(word() for _ in range(4)), " ".join(word() for _ in range(4)), f"{word().title()}{draw.randint(1, 9999)}!", some(low, 3) + some(string.digits, 3)]
        jwt = f"eyJ{some(plain, 33)}.eyJ{some(plain, 60)}.{some(plain + '-_', 43)}"
        pem = f"-----BEGIN RSA PRIVATE KEY-----\n{some(plain + '+/', 64)}\n{some(plain + '+/', 40)}\n-----END RSA PRIVATE KEY-----"
        good = [(f'{name}{sign}"{{}}"', v) for v in values] + [(f"{name}{sign}{{}} {word()}", v) for v in values[:4]]
        good += [("use {} now", f"AKIA{some(string.ascii_uppercase + string.digits, 16)}"), ("see {} there", jwt), ("Authorization: Bearer {}", jwt), ("{}", f"ghp_{some(plain, 36)}"), ("key:\n{}\n", pem), (f"postgres://{word()}:{{}}@db.example.com/{word()}", some(plain + "!$.", max(n // 2, 6)))]
        good += [(f"https://{word()}:{{}}@example.org", f"{word()}.{word()}!{word()}"), (f"amqp://{word()}:{{}}@{word()}:5672", f"{word()}{draw.choice('.-_')}{some(low + string.digits, 6)}")]
        # what only looks like one
        bad = [f"commit {some(hexa, 40)}", f"sha256: {some(hexa, 64)}", f"see {some(plain, max(n, 16))} there", f"/usr/{word()}/{word()}/{word()}{draw.randint(1, 99)}.txt", f"{word()}_{word()}_{word()}_{word()}", f"https://www.example.com/{word()}/{word()}-{word()}-{draw.randint(1, 9999)}"]
        bad += [f"the {name} is {word()}ed here", f"{name}{sign}{word()}", f"{name} = {word()}.{word()}({word()})", f"{name} = {some(low, 2)}.{word()}[{word().upper()}]", f"{name} = {word()}[{word()}]", f"{name} = ${{{word().upper()}_{word().upper()}}}", f"{name} {some(string.digits, 16)}", some(low, 3) + "-" + "-".join(word() for _ in range(4)), f"id={some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)}"]
        bad += [f'{name}{sign}"{v}"' for v in (f"YOUR_{word().upper()}_{word().upper()}_HERE", "x" * draw.randint(8, 24), "*" * draw.randint(8, 24), f"<{word()}-{word()}>", f"{word().upper()}_{word().upper()}", f"/{word()}/{word()}/{word()}.txt")]
        for text, value in [*good, *((t, None) for t in bad)]:
            at = text.index("{}") if value is not None else -1
            made = text.replace("{}", value) if value is not None else text
            for f in _found(made):
                hit = value is not None and f["start"] < at + len(value) and f["start"] + f["length"] > at
                out.append((float(hit), made, made[f["start"] : f["start"] + f["length"]], f["known"] or f["credential"] and not f["digits_only"] and not f["plain"], f["features"]))
    return out


def fit(found: DataFrame, rows: int = TRAIN_FINDINGS):
    """A random forest from labelled findings (label, features), about `rows` of them; None if both labels aren't there."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    classes = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    if len(classes) < 2:
        return None
    share = F.create_map(*[F.lit(x) for label in (0.0, 1.0) for x in (label, min(1.0, rows / 2 / classes.get(label, 1)))])
    drawn = found.where((share[F.col("label")] >= 1.0) | chosen(share[F.col("label")], "features", "label")).select("label", array_to_vector("features").alias("vector"))
    return RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.7", seed=SEED).fit(drawn)


def scored(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """findings(docs) with score (the forest's share for a secret) and is_secret (0.5 or more).

    labels: findings with `label` and `features` to train from, of both labels; default: the labelled examples. Documents never
    label themselves.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if labels is None:
        labels = docs.sparkSession.createDataFrame([(label, features) for label, *_, features in examples()], "label double, features array<double>")
    model = fit(labels)
    if model is None:
        raise ValueError("findings of both labels are needed")
    model.setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("")
    out = model.transform(materialise(findings(docs)).withColumn("vector", array_to_vector("features"))).withColumn("score", vector_to_array("p")[1])
    return out.withColumn("is_secret", F.col("score") >= 0.5)


def digest(docs: DataFrame) -> DataFrame:
    """Per candidate: doc_id, start, length, value_sha256, score, is_secret. Values themselves aren't returned.

    Null and empty texts have no candidates; repeated rows give repeated findings; extra columns are ignored; an empty
    table gives an empty result.
    """
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "start", "length", "value_sha256", "score", "is_secret")


def redact(docs: DataFrame, sign: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by `sign` and n_chars counted anew. All rows and columns stay."""
    names = docs.columns
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"), row_key().alias("rk"))
    secrets = scored(apart.select("rk", "text")).where("is_secret").select("rk", "start", "length").distinct()
    spans = secrets.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    # what stays before each secret, and the rest; places are code points from 0
    cut = f"""concat(array_join(transform(spans, (s, i) -> substring(text, cast(coalesce(get(spans, i - 1).start + get(spans, i - 1).length, 0) as int) + 1, cast(s.start - coalesce(get(spans, i - 1).start + get(spans, i - 1).length, 0) as int))), '{sign}'), '{sign}',
        substring(text, cast(element_at(spans, -1).start + element_at(spans, -1).length as int) + 1))"""
    out = apart.join(spans, "rk", "left").withColumn("new", F.expr(f"if(spans is null, text, {cut})"))
    fix = {"text": F.col("new"), **({"n_chars": F.when(F.col("new").isNotNull(), F.char_length("new").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {})}
    return out.select(*[fix.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
