"""The gated recurrence of one graph: match, check, and learn only from what was accepted. No Spark in here.

A message is a list of rows (stmt_ix, anchor, relation, kind, value, dtype, lang, num, subject), in order of stmt_ix, where dtype is
the inferred datatype and num the number a literal stands for. `step` takes a state and a message and gives findings; batch replay
and streaming share it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from typing import Any

import numpy as np

from ..config import Settings
from ..functions.terms import CONTINUOUS, CRITICAL, ERROR, FAMILIES, INCONSISTENCY, NODATA, NOMINAL, RDFS_RESOURCE, SUSPICIOUS, XSD

_CONTINUOUS = {XSD + n for n in CONTINUOUS}
_DISCRETE = {XSD + n for names in FAMILIES.values() for n in names} - _CONTINUOUS
_NUMERIC = {XSD + n for n in FAMILIES["numeric"] + FAMILIES["datetime"] + FAMILIES["datefrag"]}
_STAMPS = {XSD + "dateTime"}
State = dict[str, Any]
Finding = tuple[str | None, int | None, str, int, str]


def _value(row: tuple) -> float | str:
    return row[7] if row[5] in _NUMERIC and row[7] is not None else (row[4] or "").strip()


def _dtype(row: tuple) -> str | None:
    return row[5] if row[3] == "literal" else XSD + "anyURI"


def _pattern(ap_id: str, row: tuple, t: int) -> State:
    return {"id": ap_id, "anchor": row[1], "relation": row[2], "t": 1, "freq": 1, "status": "nominal", "kind": row[3], "value": row[4], "dtype": row[5], "lang": row[6], "num": row[7], "dist": None, "born": t}


def _empty() -> State:
    return {"counts": {}, "n": 0, "t": 0, "order": [], "sorted": []}


def _add(dist: State, value: float | str, decay: int) -> None:
    """A sample joins the multiset in its first-seen place; with decay D the D - 1 latest stay. Numbers are kept sorted, too."""
    dist["counts"][value] = dist["counts"].get(value, 0) + 1
    dist["t"] += 1
    dist["n"] += 1
    if not isinstance(value, str):
        bisect.insort(dist["sorted"], value)
    if decay > 0:
        dist["order"].append(value)
        while len(dist["order"]) >= decay:
            old = dist["order"].pop(0)
            dist["n"] -= 1
            if not isinstance(old, str):
                dist["sorted"].pop(bisect.bisect_left(dist["sorted"], old))
            dist["counts"][old] -= 1
            if not dist["counts"][old]:
                del dist["counts"][old]


def _data(dist: State) -> list:
    return [v for v, n in dist["counts"].items() for _ in range(n)]


def _weak(ap: State, row: tuple, classes: dict[str, str]) -> bool:
    if ap["dist"] is None and ap["kind"] == row[3] == "iri":
        return classes.get(ap["value"], RDFS_RESOURCE) == classes.get(row[4], RDFS_RESOURCE)
    if ap["dist"] is None:
        return ap["kind"] == row[3] == "literal" and ap["dtype"] == row[5]
    return row[3] != "bnode" and ap["dtype"] == _dtype(row) and (ap["continuous"] is False or row[3] == "literal")


def _match(aps: list[State], rows: list[tuple], all_rows: list[tuple]) -> tuple[list[tuple[State, tuple]], list[tuple]]:
    """Pairs, and the rows that match nothing. Conflicts and lone anchor-relation rows are dropped."""
    times = Counter([(r[1], r[2]) for r in all_rows] + [(a["anchor"], a["relation"]) for a in aps])
    classes = {r[8]: r[1] for r in all_rows}  # a statement's anchor is the class of its subject
    pairs, rest = [], []
    for r in rows:
        own = [a for a in aps if (a["anchor"], a["relation"]) == (r[1], r[2])]
        n = times[(r[1], r[2])]
        hits = own if n == 2 else [a for a in own if _weak(a, r, classes)]
        if len(hits) == 1:
            pairs.append((hits[0], r))
        elif not hits and n > 1:
            rest.append(r)
    return pairs, rest


def interval(data: list[float], p: float) -> tuple[float, float]:
    """Order-statistic prediction interval of 100 sorted numbers or more."""
    n = len(data)
    low = max(0.0, (n + 1 - (n + 1) * p) / 2 - 1)
    high = min(n - low - 1, n - 1)
    at = lambda r: data[int(r)] + (data[min(int(np.ceil(r)), n - 1)] - data[int(r)]) * (r - int(r))
    return at(low), at(high)


def _moments(x: np.ndarray) -> np.ndarray:
    return np.stack([x.mean(1), x.std(1, ddof=1), np.median(x, 1)], 1)


def bootstrap(sample: list, population: list, continuous: bool, resamples: int, rng: np.random.Generator) -> list[float]:
    """One-sided p values, how often the population's statistic is the lesser: mean, spread and median, or the share of each value."""
    m = int(0.67 * len(sample))
    if continuous:
        a, b = (_moments(np.asarray(s, float)[rng.integers(0, len(s), (resamples, m))]) for s in (population, sample))
        return (a < b).mean(0).tolist()
    names = {v: i for i, v in enumerate(dict.fromkeys([*population, *sample]))}
    sides = [np.array([names[v] for v in s])[rng.integers(0, len(s), (resamples, m))] for s in (population, sample)]
    shares = [np.stack([(s == i).mean(1) for i in range(len(names))], 1) for s in sides]
    seen = (shares[0] > 0) & (shares[1] > 0)
    return [float((shares[0][:, i] < shares[1][:, i])[seen[:, i]].mean()) if seen[:, i].any() else 0.5 for i in range(len(names))]


class Fit:
    """The test of fit of a distribution as it stands, for any new value: `bootstrap` of its latest values and the new one against its
    population, with the same draws and results. The draws don't depend on the value, so what it leaves unchanged is computed once.
    """

    MEMO = 1 << 16

    def __init__(self, ap: State, graph_id: str, s: Settings):
        self.dist, self.at, self.s = ap["dist"], _standing(ap), s
        self.keys = list(self.dist["counts"])
        ends = np.cumsum([self.dist["counts"][k] for k in self.keys], dtype=np.int64)
        n = int(ends[-1]) if len(ends) else 0
        size = max(0, n - s.samplesize - s.samplegap)
        self.some = size > 0
        self.told: dict[float | str, tuple[str, int, str] | None] = {}
        if not self.some:
            return
        seed = zlib.crc32(f"{s.seed}:{graph_id}:{ap['id']}:{ap['t']}".encode())
        self.rng = lambda: np.random.default_rng(seed)
        rng, latest = self.rng(), np.searchsorted(ends, np.arange(max(0, n - s.samplesize), n), side="right")
        m = int(0.67 * (len(latest) + 1))
        drawn = np.searchsorted(ends, rng.integers(0, size, (s.resamples, m)), side="right")
        places = rng.integers(0, len(latest) + 1, (s.resamples, m))
        self.continuous = ap["continuous"]
        if not self.continuous:
            self._shares(drawn, places, latest, int(np.searchsorted(ends, size - 1, side="right")) + 1)
        elif len(self.dist["sorted"]) == n:
            values = np.asarray(self.keys, float)
            population, own = _moments(values[drawn]), np.append(values[latest], 0.0)
            hit = (places == len(latest)).any(1)
            self.fixed = (population[~hit] < _moments(own[places[~hit]])).sum(0)
            self.own, self.places, self.population = own, places[hit], population[hit]
        else:
            self.own = None  # texts among the numbers

    def _shares(self, drawn: np.ndarray, places: np.ndarray, latest: np.ndarray, known: int) -> None:
        """known: so many of the keys are in the population."""
        names = [*range(known), *range(max(known, int(latest[0])), len(self.keys))]
        self.names = {self.keys[k]: i for i, k in enumerate(names)}
        self.drawn, self.known = drawn, known
        self.key = {v: i for i, v in enumerate(self.keys)}
        times = np.stack([(places == i).sum(1) for i in range(len(latest) + 1)])
        self.new, self.old = times[-1], {int(k): times[:-1][latest == k].sum(0) for k in np.unique(latest)}
        self.base = np.full(len(names), 0.5)
        for k, counts in self.old.items():
            self.base[self.names[self.keys[k]]] = self._share(k, counts)

    def _share(self, key: int, counts: np.ndarray) -> float:
        ahead = (self.drawn == key).sum(1) if key < self.known else np.zeros(len(counts), np.int64)
        seen = (ahead > 0) & (counts > 0)
        return float((ahead < counts)[seen].mean()) if seen.any() else 0.5

    def chances(self, value: float | str) -> np.ndarray | list[float]:
        """What `bootstrap` gives for the latest values and this one."""
        if not self.continuous:
            if value not in self.names:
                return np.append(self.base, 0.5)
            p, key = self.base.copy(), self.key[value]
            p[self.names[value]] = self._share(key, self.old.get(key, 0) + self.new)
            return p
        if self.own is None or isinstance(value, str):
            data = _data(self.dist)
            return bootstrap([*data[-self.s.samplesize :], value], data[: -(self.s.samplesize + self.s.samplegap)], True, self.s.resamples, self.rng())
        self.own[-1] = value
        less = (self.population < _moments(self.own[self.places])).sum(0) if len(self.places) else 0
        return (self.fixed + less) / self.s.resamples

    def finding(self, value: float | str, levels: tuple) -> tuple[str, int, str] | None:
        """The finding of a new value, if there is one; while nothing is learnt, equal values have equal ones."""
        if value not in self.told:
            if len(self.told) >= self.MEMO:
                self.told.clear()
            self.told[value] = self._finding(value, levels)
        return self.told[value]

    def _finding(self, value: float | str, levels: tuple) -> tuple[str, int, str] | None:
        p = np.asarray(self.chances(value))
        for alpha, code, name in levels:
            votes = int(((p < alpha / 2) | (p > 1 - alpha / 2)).sum())
            if votes * 2 > len(p) if self.continuous else votes:
                return f"{name} Pattern Violation", code, _expected(f"last {self.s.samplesize} values", f"a chance of {alpha} or more", f"{np.mean(p):.2f}")
        return None


def _standing(ap: State) -> tuple[int, int, int]:
    return ap["t"], ap["dist"]["t"], ap["dist"]["n"]


def _fit(ap: State, graph_id: str, s: Settings, fits: dict[str, Fit] | None) -> Fit:
    """The pattern's test of fit: the one of `fits` as long as its distribution is the same."""
    fit = None if fits is None else fits.get(ap["id"])
    if fit is None or fit.dist is not ap["dist"] or fit.at != _standing(ap):
        fit = Fit(ap, graph_id, s)
        if fits is not None:
            fits[ap["id"]] = fit
    return fit


def _expected(what: str, expected: object, observed: object) -> str:
    return f"{what}: expected {expected}, observed {observed}"


def _static(ap: State, r: tuple) -> list[tuple[str, int, str]]:
    out = []
    if ap["kind"] != r[3]:
        out.append(("Resource Type Violation", INCONSISTENCY, _expected("kind of resource", ap["kind"], r[3])))
    if ap["kind"] == "literal" and ap["dtype"] != r[5]:
        out.append(("Data Type Violation", INCONSISTENCY, _expected("datatype", ap["dtype"], r[5])))
    if ap["value"] != r[4]:
        out.append(("Value Equality Violation", CRITICAL, _expected("value", f"'{ap['value']}'", f"'{r[4]}'")))
    if ap["kind"] == "literal" and ap["lang"] and r[6] and ap["lang"] != r[6]:
        out.append(("Value Language Violation", INCONSISTENCY, _expected("language", ap["lang"], r[6])))
    return out


def _distribution(ap: State, r: tuple, graph_id: str, s: Settings, fits: dict[str, Fit] | None = None) -> list[tuple[str, int, str]]:
    out, literal = [], r[3] == "literal"
    if (ap["continuous"] or ap["dtype"] != XSD + "anyURI") and not literal:
        out.append(("Resource Type Violation", CRITICAL, _expected("kind of resource", "literal", r[3])))
    if literal:
        if r[5] not in (_CONTINUOUS if ap["continuous"] else _DISCRETE):
            out.append(("Value Type Violation", INCONSISTENCY, _expected("datatype", "a continuous one" if ap["continuous"] else "a discrete one", r[5])))
        if r[5] != ap["dtype"]:
            out.append(("Data Type Violation", INCONSISTENCY, _expected("datatype", ap["dtype"], r[5])))
    counts = ap["dist"]["counts"]
    n = ap["dist"]["n"]
    clean = not out
    if n < 2 * s.samplesize + s.samplegap:
        out.append(("Insufficient Data", NODATA, _expected("samples", f"{2 * s.samplesize + s.samplegap} or more", n)))
    fluid = not ap["continuous"] and len(counts) > 1 and len(counts) == n
    if fluid or (ap["dtype"] in _STAMPS and not s.evaluate_timestamps) or not clean:
        return out
    value = _value(r)
    levels = ((s.alpha_critical, CRITICAL, "Critical"), (s.alpha_suspicious, SUSPICIOUS, "Suspicious"))
    if isinstance(value, str):
        if value not in counts:
            out.append(("Critical Value Violation", CRITICAL, _expected("value", f"one of {len(counts)} known ones", f"'{value}'")))
    elif n >= 100:
        for alpha, code, name in levels:
            lo, hi = interval(ap["dist"]["sorted"], 1 - alpha)
            by = abs(hi - lo) * s.pi_tolerance
            if value <= lo - by or value > hi + by:
                out.append((f"{name} Value Violation", code, _expected(f"{1 - alpha:.0%} prediction interval", f"({lo:.3g}, {hi:.3g}] and {by:.3g} beyond", f"'{r[4]}'")))
                break
    if ap["t"] % (s.samplesize // 2):
        return out
    fit = _fit(ap, graph_id, s, fits)
    found = fit.finding(value, levels) if fit.some else None  # whatever the value's own finding is
    return [*out, found] if found else out


def _learn(ap: State, r: tuple, s: Settings) -> None:
    if ap["dist"] is None and (ap["kind"], ap["value"], ap["dtype"], ap["lang"]) != (r[3], r[4], r[5], r[6]):
        old = (0, "", "", ap["kind"], ap["value"], ap["dtype"], ap["lang"], ap["num"])
        ap |= {"dtype": _dtype(r), "continuous": _dtype(r) in _CONTINUOUS, "dist": _empty()}
        for v in [_value(old)] + [_value(r)] * ap["t"]:  # the old value once, the new one as often as the pattern was met
            _add(ap["dist"], v, s.pattern_decay)
    elif ap["dist"] is not None:
        value = _value(r)
        if s.pattern_resolution > 0 and ap["continuous"] and isinstance(value, float):
            value = float(f"{value:.{s.pattern_resolution}g}")
        _add(ap["dist"], value, s.pattern_decay)
    ap["t"] += 1


def _check_learning(pairs: list[tuple[State, tuple]]) -> None:
    """Raises where a pattern can't learn its statement, before anything of the state has changed."""
    converted = set()
    for ap, r in pairs:
        if ap["dist"] is None and ap["id"] not in converted and (ap["kind"], ap["value"], ap["dtype"], ap["lang"]) != (r[3], r[4], r[5], r[6]):
            if _dtype(r) not in _CONTINUOUS | _DISCRETE:
                raise ValueError(f"no distribution of {_dtype(r)}")
            converted.add(ap["id"])


def step(state: State | None, graph_id: str, seq: int, rows: list[tuple], s: Settings, fits: dict[str, Fit] | None = None) -> tuple[State, list[Finding], int | None]:
    """The next state, the findings (ap_id, stmt_ix, label, code, message) and the report's code (None: first message, no report).

    fits: a dictionary that the caller keeps for the graph, so that tests of fit are computed once while nothing is learnt.
    """
    if state is None:
        return {"t": 1, "aps": [_pattern(f"{graph_id}:{seq}:{r[0]}", r, 1) for r in rows], "due": {}}, [], None
    findings: list[Finding] = []
    try:
        nominal = [a for a in state["aps"] if a["status"] == "nominal"]
        pairs, rest = _match(nominal, rows, rows)
        more, rest = _match([a for a in state["aps"] if a["status"] == "candidate"], rest, rows) if rest else ([], [])
        if s.evaluate_structure and state["t"] >= s.grace_period:
            short, extra = len(pairs) < len(nominal), len(rest) + len(more) > 0
            if (short and (s.match_cwa or s.match_exact)) or (not short and extra and s.match_exact):
                label = "Exact Match Requirement Violation" if s.match_exact else "Closed-World Assumption Violation"
                findings.append((None, None, label, INCONSISTENCY, _expected("statements", f"{len(nominal)} that match", f"{len(pairs)} that match and {len(rest) + len(more)} others")))
        if s.evaluate_data:
            for ap, r in pairs:
                if ap["t"] >= s.grace_period:
                    found = _static(ap, r) if ap["dist"] is None else _distribution(ap, r, graph_id, s, fits)
                    findings += [(ap["id"], r[0], *f) for f in found]
        code = max((f[3] for f in findings), default=NOMINAL)
        if code in (NOMINAL, NODATA):
            _update(state, graph_id, seq, pairs, more, rest, s)
        return state, findings, code
    except (ValueError, TypeError, ArithmeticError) as e:
        return state, [(None, None, f"Validation Malfunction: {e}", ERROR, str(e))], ERROR


def _update(state: State, graph_id: str, seq: int, pairs: list, more: list, rest: list, s: Settings) -> None:
    """The whole step or, if a statement can't be learnt, none of it."""
    ordered = sorted(pairs + more, key=lambda x: x[1][0])
    _check_learning(ordered)
    for ap, r in ordered:
        _learn(ap, r, s)
        ap["freq"] += 1
        if s.pattern_decay > 0:
            due = state["due"].setdefault(str(state["t"] + s.pattern_decay), [])
            if ap["id"] not in due:  # once, however many statements met it
                bisect.insort(due, ap["id"])
    for r in rest:
        state["aps"].append(_pattern(f"{graph_id}:{seq}:{r[0]}", r, state["t"]) | {"status": "candidate"})
        if s.pattern_decay > 0:
            bisect.insort(state["due"].setdefault(str(state["t"] + s.pattern_decay), []), state["aps"][-1]["id"])
    state["t"] += 1
    for ap in state["aps"]:
        if ap["status"] == "candidate" and s.pattern_threshold > 0 and ap["freq"] >= s.pattern_threshold:
            ap["status"] = "nominal"
    for ap_id in state["due"].pop(str(state["t"]), []):
        for ap in state["aps"]:
            if ap["id"] == ap_id:
                ap["freq"] -= 1
    if s.pattern_decay > 0:
        state["aps"] = [a for a in state["aps"] if a["freq"] > 0]
