"""Several values packed in one field: one row for each item, with its position.

Every distinct value (quotes, escapes and outer blanks aside) becomes a lattice: quoted spans are atoms, escaped characters are text, and each punctuation mark
outside them, tab or line break is a place where the value may be cut. A segment joins neighbouring atoms, so that "a/b"
may be two items or one; its item is the text as it stands. No mark is a delimiter beforehand: all start alike, under
every key (with a weak lean to cut, worth two observations). How often each item occurs, and how often each mark parts items under its key, is learned from the whole
column by expectation-maximisation: the E step weighs the segmentations of each lattice by a forward-backward pass, the M
step adds the weights up over all values, until no mark's chance to cut moves by more than ``TOLERANCE``. Viterbi then
takes the best path.

* An item weighs what it has in *other* values (a value is no evidence for its own segmentation), smoothed by a measure
  of new items: the characters' frequencies under the key and a chance to stop after each, so that long new items are
  less likely than short ones. What new items weigh together is learned too: the share of items seen once.
* A mark's chance to cut under a key starts from that of the mark under all keys, with the weight of one observation.

Segments are single atoms, pairs, and the whole value. Where marks stay open (they cut with a chance below ``OPEN``), values
with a run of them are taken again, with the longest runs over open marks and over one of them, and runs of any length
whose pairs other values hold too; and learning goes on.

Marks in a key's ``inner`` characters belong to items and never cut, tabs and line breaks always do, blanks alone never.
Quotes open at the start of an item only, and close before the next delimiter or the end; a mark that doesn't is text.

Defined results: null and empty values have no items; items are trimmed and empty ones are dropped before positions are
counted; rows repeated in full give one result; values of any length are split whole (the work and memory of a value
are linear in it, but for runs of n open marks whose every pair other values hold too: n * n / 2 segments of these are tried); an empty table, or no keys, gives no rows; extra columns are never read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import materialize, release

#: Pairs of quotation marks.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』"}
ESCAPE = "\\"
_TEXT = frozenset([*QUOTES, *QUOTES.values(), ESCAPE, "_"])
HARD = "\t\n\r"
#: Learning ends when no chance to cut moves by more; the rounds have a bound all the same.
TOLERANCE, ROUNDS = 0.01, 60
#: The chance to cut of a mark of which nothing is known; it counts as two observations of the mark.
LEAN = 0.75
#: Marks that cut with a lower chance are open: items may hold any number of them.
OPEN = 0.9


@lru_cache(maxsize=4096)
def _punctuation(c: str) -> bool:
    """Marks that may part items: punctuation and mathematical signs, but no quotation marks, escapes or low lines."""
    return (unicodedata.category(c)[0] == "P" or unicodedata.category(c) == "Sm") and c not in _TEXT


def _closed(v: str, i: int, inner: frozenset) -> tuple[int, str] | None:
    """The end of the quoted span that begins at ``i`` and its text, or None if it isn't closed before a delimiter."""
    close, same = QUOTES[v[i]], QUOTES[v[i]] == v[i]
    out, j = [], i + 1
    while j < len(v):
        c = v[j]
        if c == ESCAPE and j + 1 < len(v):
            out.append(v[j + 1])
            j += 2
        elif c == close:
            if same and v[j + 1 : j + 2] == close:
                out.append(c)
                j += 2
                continue
            k = j + 1
            while k < len(v) and v[k] == " ":
                k += 1
            if k == len(v) or v[k] in HARD or (_punctuation(v[k]) and v[k] not in inner):
                return j + 1, "".join(out)
            out.append(c)
            j += 1
        else:
            out.append(c)
            j += 1
    return None


def atoms(v: str, inner: str) -> tuple[list[str], list[str], list[str]]:
    """The trimmed atoms of a value (some empty), the marks between them, one less, and these with the blanks around them."""
    held = frozenset(inner)
    texts, marks, links, own, lead, i, start = [], [], [], [], "", 0, True

    def end() -> None:
        raw = "".join(own)
        texts.append(raw.strip())
        if marks:
            links[-1] += lead + raw[: len(raw) - len(raw.lstrip())]
        links.append(raw[len(raw.rstrip()) :] if texts[-1] else "")

    while i < len(v):
        c = v[i]
        if c == ESCAPE and i + 1 < len(v):
            own.append(v[i + 1])
            i, start = i + 2, False
        elif start and c in QUOTES and (span := _closed(v, i, held)):
            lead, own, i, start = "".join(own), [span[1]], span[0], False
        elif c in HARD or (c not in held and _punctuation(c)):
            end()
            marks.append(c)
            links[-1] += c
            own, lead, i, start = [], "", i + 1, True
        else:
            own.append(c)
            i, start = i + 1, start and c.isspace()
    end()
    return texts, marks, links[:-1]


def segments(texts: list[str], marks: list[str], links: list[str] | None = None, open_marks: frozenset | None = None, shared: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """(first, last, item) of the segments of a lattice, in order; empty atoms are joined with nothing.

    All there are; or with ``open_marks`` atoms, pairs, the whole, the longest runs over open marks and over one of them,
    and every run over open marks whose pairs are all ``shared`` (places of pairs that other values hold too).
    """
    links, n = marks if links is None else links, len(texts)
    may = [bool(texts[i] and texts[i + 1]) and marks[i] not in HARD for i in range(n - 1)]
    found = {(i, i) for i in range(n)} | {(i, i + 1) for i in range(n - 1) if may[i]}
    if n > 1 and all(may):
        found.add((0, n - 1))
    for same in (False, True) if open_marks is not None else ():
        i = 0
        while i < n:
            j = i
            while j < n - 1 and may[j] and marks[j] in open_marks and (not same or marks[j] == marks[i]):
                j += 1
            found.add((i, j))
            i = max(j, i + 1) if same and j > i else j + 1
    for i in range(n):
        for j in range(i, n - 1):
            if not may[j] or open_marks is not None and not (marks[j] in open_marks and j in shared):
                break
            found.add((i, j + 1))
    return [(i, j, _whole(texts[i : j + 1], links[i:j])) for i, j in sorted(found)]


def _whole(texts: list[str], links: list[str]) -> str:
    return "".join([x for pair in zip(texts, links) for x in pair] + texts[-1:])


def _plain(texts: list[str], marks: list[str], links: list[str]) -> list[str]:
    """The items of a lattice without runs, in fixed order: n atoms, n - 1 pairs, the whole of three and more; empty where there is none."""
    n = len(texts)
    hard = [m in HARD for m in marks]
    pairs = [texts[i] + links[i] + texts[i + 1] if texts[i] and texts[i + 1] and not hard[i] else "" for i in range(n - 1)]
    return texts + pairs + ([_whole(texts, links) if all(texts) and not any(hard) else ""] if n > 2 else [])


def _score(i: int, j: int, p: float, marks: list[str], cut: dict[str, float]) -> float:
    """Log weight of a segment with the marks inside it and the one behind it."""
    return math.log(max(p, 1e-300)) + _marks(i, j, marks, cut)


def _marks(i: int, j: int, marks: list[str], cut: dict[str, float]) -> float:
    s = sum(math.log(max(1 - cut[m], 1e-300)) for m in marks[i:j])
    return s + math.log(max(cut[marks[j]], 1e-300)) if j < len(marks) else s


def _best(n: int, scored: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The path of the highest score; segments (first, last, score) come in order of their first."""
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i, j, s in scored:
        if best[i] + s > best[j + 1]:
            best[j + 1], back[j + 1] = best[i] + s, i
    path, at = [], n
    while at:
        path.append((back[at], at - 1))
        at = back[at]
    return path[::-1]


def _weights(n: int, scored: list[tuple[int, int, float]]) -> list[float]:
    """The probability of each segment over all paths, by forward and backward sums in logs."""
    exp, none = math.exp, -math.inf

    def add(a: float, b: float) -> float:
        return b if a == none else a if b == none else max(a, b) + math.log1p(exp(-abs(a - b)))

    fore, rear = [0.0] + [none] * n, [none] * n + [0.0]
    for i, j, s in scored:
        fore[j + 1] = add(fore[j + 1], fore[i] + s)
    for i, j, s in reversed(scored):
        rear[i] = add(rear[i], rear[j + 1] + s)
    return [exp(min(0.0, fore[i] + s + rear[j + 1] - fore[n])) for i, j, s in scored]


def viterbi(n: int, marks, segs, probs, cut) -> list[tuple[int, int]]:
    """The likeliest segmentation of ``n`` atoms; ``segs`` come in order of their first."""
    return _best(n, [(i, j, _score(i, j, p, marks, cut)) for (i, j, _), p in zip(segs, probs)])


def posteriors(n: int, marks, segs, probs, cut) -> list[float]:
    """The probability of each segment over all segmentations."""
    return _weights(n, [(i, j, _score(i, j, p, marks, cut)) for (i, j, _), p in zip(segs, probs)])


class Letters:
    """The measure of new items under each key: log chances of characters, and to stop and to go on after one."""

    def __init__(self, counts: dict[str, Counter]):
        self.log: dict[str, dict[str, float]] = {}
        self.rare: dict[str, float] = {}
        self.stop: dict[str, tuple[float, float]] = {}
        for k, seen in counts.items():
            parts = (seen.pop(_BREAK, 1) + 2) / 3  # three breaks an atom: before it, its mark, and the mark's link
            total = sum(seen.values()) or 1
            stop = min(max(parts / total, 1e-3), 0.9)
            self.log[k] = {c: math.log(n / total) for c, n in seen.items()}
            self.rare[k] = -math.log(total + 1)
            self.stop[k] = math.log(stop), math.log(1 - stop)

    def of(self, k: str, texts: list[str], marks: list[str], segs: list[tuple[int, int] | None]) -> list[float | None]:
        """Of each segment (first, last): its atoms and the marks inside, without the blanks around these."""
        log, rare, (stop, on) = self.log[k], self.rare[k], self.stop[k]
        atom, mark = [0.0], [0.0]
        for t in texts:
            atom.append(atom[-1] + sum([log.get(c, rare) for c in t]) + on * len(t))
        for m in marks:
            mark.append(mark[-1] + log.get(m, rare) + on)
        return [None if x is None else atom[x[1] + 1] - atom[x[0]] + mark[x[1]] - mark[x[0]] + stop - on for x in segs]


_BREAK, _SHIFT = "\x1f", "\x1e"


def _pack(texts: list[str], marks: list[str], links: list[str]) -> str:
    """The atoms, marks and links of a value as one string, by which equal lattices are found."""
    parts = [texts[0]]
    for x in zip(marks, links, texts[1:]):
        parts += x
    if any(_BREAK in x or _SHIFT in x for x in parts):
        parts = [x.replace(_SHIFT, _SHIFT + "0").replace(_BREAK, _SHIFT + "1") for x in parts]
    return _BREAK.join(parts)


def _unpack(packed: str) -> tuple[list[str], list[str], list[str]]:
    parts = packed.split(_BREAK)
    if _SHIFT in packed:
        parts = [x.replace(_SHIFT + "1", _BREAK).replace(_SHIFT + "0", _SHIFT) for x in parts]
    return parts[::3], parts[1::3], parts[2::3]


def _packed(columns: list[str]):
    """``columns`` and ``lattice`` of each row of (``columns``, v, inner)."""

    def run(batches):
        for b in batches:
            packed = [_pack(*atoms(v, inner or "")) for v, inner in zip(b.column("v").to_pylist(), b.column("inner").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(packed, pa.string())], names=[*columns, "lattice"])

    return run


_LATTICE = "k string, lattice string, n bigint, texts array<string>, marks array<string>, links array<string>, runs array<struct<i:int,j:int>>, h array<bigint>, same array<int>, base array<float>"
_LATTICE_TYPES = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float32())]


def _number(k: str, item: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{k}\0{item}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _lattices(letters: Letters, open_marks: dict[str, frozenset]):
    """(``_LATTICE``): ``h`` numbers the items, ``same`` says how often the value offers each, ``base`` is their measure as new
    items (null: no item, as the atom is empty or can't be joined); ``runs`` are the segments of lattices with runs of open marks."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            shared = b.column("at").to_pylist() if "at" in b.schema.names else [()] * b.num_rows
            for k, packed, at in zip(b.column("k").to_pylist(), b.column("lattice").to_pylist(), shared):
                texts, marks, links = _unpack(packed)
                own, n = open_marks.get(k), len(texts)
                if own and any(x in own and y in own for x, y in zip(marks, marks[1:])):
                    segs = segments(texts, marks, links, own, frozenset(x - n for x in at))
                    items, runs = [x[2] for x in segs], [{"i": i, "j": j} for i, j, _ in segs]
                    places = [x[:2] for x in segs]
                else:
                    items, runs = _plain(texts, marks, links), []
                    places = [(i, i) for i in range(n)] + [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)] * (n > 2)
                h = [_number(k, x) if x else None for x in items]
                times = Counter(h)
                base = letters.of(k, texts, marks, [p if x else None for p, x in zip(places, items)])
                for c, x in zip(cols, (texts, marks, links, runs, h, [times[x] for x in h], base)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("lattice"), b.column("n"), *(pa.array(c, t) for c, t in zip(cols, _LATTICE_TYPES))], names=["k", "lattice", "n", "texts", "marks", "links", "runs", "h", "same", "base"])

    return run


@dataclass
class Model:
    """What was learned: the chance of each (key, mark) to cut, and for each key the weight of all its items and that of those seen once."""

    cut: dict[tuple[str, str], float] = field(default_factory=dict)
    items: dict[str, float] = field(default_factory=dict)
    once: dict[str, float] = field(default_factory=dict)

    def chance(self, k: str, m: str) -> float:
        return 1.0 if m in HARD else self.cut.get((k, m), LEAN)

    @staticmethod
    def chances(used: dict[tuple[str, str], list[float]]) -> dict[tuple[str, str], float]:
        pool: dict[str, list[float]] = {}
        for (_, m), (a, b) in used.items():
            x = pool.setdefault(m, [0.0, 0.0])
            x[0], x[1] = x[0] + a, x[1] + b
        every = {m: (a + 2 * LEAN) / (a + b + 2) for m, (a, b) in pool.items()}
        return {(k, m): (a + every[m]) / (a + b + 1) for (k, m), (a, b) in used.items()}

    def open_marks(self) -> dict[str, frozenset]:
        out: dict[str, set] = {}
        for (k, m), p in self.cut.items():
            if p < OPEN and m not in HARD:
                out.setdefault(k, set()).add(m)
        return {k: frozenset(x) for k, x in out.items()}


class _Batch:
    """Lattices of one batch as flat arrays: scores of all segments, and of the marks, under a model.

    Columns k, n, marks, runs, base, and ``at``, ``h``, ``w``: the segments whose items other values offer too, with the weights these have there.
    """

    def __init__(self, b: pa.RecordBatch, model: Model):
        col = {c: b.column(c) for c in b.schema.names}
        offsets = lambda c: col[c].offsets.to_numpy().astype(np.int64)
        flat = lambda c: col[c].flatten()
        self.rows = b.num_rows
        self.keys = col["k"].to_pylist()
        self.n = col["n"].to_numpy().astype(float)
        self.first = offsets("base")
        self.mark_at = offsets("marks")
        self.size = np.diff(self.mark_at) + 1
        self.marks = flat("marks").to_pylist()
        ends = offsets("runs")
        self.irregular = np.flatnonzero(np.diff(ends))
        self.runs = [(int(r), [(x["i"], x["j"]) for x in col["runs"][int(r)].as_py()]) for r in self.irregular]
        base = flat("base").to_numpy(zero_copy_only=False).astype(float)  # null is not-a-number
        count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), count)
        names = sorted(set(self.keys))
        code = np.array([names.index(k) for k in self.keys], np.int64)
        items, once = (np.array([d.get(k, 0.0) for k in names]) for d in (model.items, model.once))
        own = code[self.row]
        shared = offsets("at")
        self.at = np.repeat(self.first[:-1], np.diff(shared)) + flat("at").to_numpy(zero_copy_only=False).astype(np.int64)
        self.h = flat("h").to_numpy(zero_copy_only=False)
        weight = np.zeros(len(base))
        weight[self.at] = flat("w").to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.logaddexp(np.log(weight) - np.log(items + 1)[own], np.log((once + 1) / (items + 2))[own] + base)
        self.item = ~np.isnan(base)
        # an empty atom costs nothing; an empty pair or whole can't be taken
        place = np.arange(len(base)) - self.first[:-1][self.row]
        self.score = np.where(self.item, score, np.where(place < self.size[self.row], 0.0, -np.inf))
        chance = {(k, m): model.chance(k, m) for k, m in set(zip(np.repeat(np.array(self.keys, object), self.size - 1).tolist(), self.marks))}
        cut = np.array([chance[x] for x in zip(np.repeat(np.array(self.keys, object), self.size - 1).tolist(), self.marks)] or [], float)
        self.cut, self.keep = np.log(np.maximum(cut, 1e-300)), np.log(np.maximum(1 - cut, 1e-300))
        self.model = model

    def scored(self, r: int, runs: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
        marks = self.marks[self.mark_at[r] : self.mark_at[r + 1]]
        cut = {m: self.model.chance(self.keys[r], m) for m in set(marks)}
        own, item = self.score[self.first[r] : self.first[r + 1]].tolist(), self.item[self.first[r] : self.first[r + 1]].tolist()
        return [(i, j, (s if there else 0.0) + _marks(i, j, marks, cut)) for (i, j), s, there in zip(runs, own, item)]

    def regular(self):
        """Rows without runs, longest first, and the scores with their marks: (rows, atoms, pairs, wholes), where atoms[t] and
        pairs[t] are those of the first rows, as many as are so long."""
        rows = np.setdiff1d(np.arange(self.rows), self.irregular)
        rows = rows[np.argsort(-self.size[rows], kind="stable")]
        size, first, mark = self.size[rows], self.first[rows], self.mark_at[rows]
        long = lambda t: int(np.searchsorted(-size, -t, side="left"))  # noqa: E731  # rows of more than t atoms
        most = int(size[0]) if len(rows) else 0
        total = np.concatenate([[0.0], np.cumsum(self.keep)])
        atoms_, pairs = [], []
        for t in range(most):
            m, more, two = long(t), long(t + 1), long(t + 2)
            a = self.score[first[:m] + t]
            a[:more] += self.cut[mark[:more] + t]
            atoms_.append(a)
            p = self.score[first[:more] + size[:more] + t] + self.keep[mark[:more] + t]
            p[:two] += self.cut[mark[:two] + t + 1]
            pairs.append(p)
        three = long(2)
        whole = np.full(len(rows), -np.inf)
        whole[:three] = self.score[first[:three] + 2 * size[:three] - 1] + total[mark[:three] + size[:three] - 1] - total[mark[:three]]
        return rows, atoms_, pairs, whole


def _expect(model: Model):
    """E step: (k, what, name, h, weight): items that several values offer (what 0, h), marks that cut (1) and that don't
    (2), and of each key the weight of its items (3) and of those seen once (4)."""

    def run(batches):
        for b in batches:
            x = _Batch(b, model)
            post, inside = np.zeros(len(x.score)), np.zeros(len(x.marks))
            rows, atoms_, pairs, whole = x.regular()
            size, first, mark = x.size[rows], x.first[rows], x.mark_at[rows]
            fore = [np.zeros(len(rows))]
            for t in range(len(atoms_)):
                m = len(atoms_[t])
                f = fore[t][:m] + atoms_[t]
                if t:
                    f = np.logaddexp(f, fore[t - 1][:m] + pairs[t - 1][:m])
                fore.append(f)
            last = np.zeros(len(rows))
            for t in range(len(atoms_)):
                last[: len(fore[t + 1])] = fore[t + 1]
            last = np.logaddexp(last, whole)
            rear = {len(atoms_): np.zeros(0), len(atoms_) + 1: np.zeros(0)}
            pad = lambda r, m, fill: np.concatenate([r, np.full(m - len(r), fill)])
            for t in range(len(atoms_) - 1, -1, -1):
                m, more = len(atoms_[t]), len(pairs[t])
                after = pad(rear[t + 1], m, 0.0)  # rows that end here
                post[first[:m] + t] = np.exp(np.minimum(0.0, fore[t][:m] + atoms_[t] + after - last[:m]))
                r = atoms_[t] + after
                if more:
                    behind = pad(rear[t + 2], more, 0.0)
                    two = np.exp(np.minimum(0.0, fore[t][:more] + pairs[t] + behind - last[:more]))
                    post[first[:more] + size[:more] + t] = two
                    inside[mark[:more] + t] += two
                    r[:more] = np.logaddexp(r[:more], pairs[t] + behind)
                rear[t] = r
            three = size > 2
            post[first[three] + 2 * size[three] - 1] = np.exp(np.minimum(0.0, whole - last))[three]
            for r, s, w in zip(rows[three].tolist(), size[three].tolist(), post[first[three] + 2 * size[three] - 1].tolist()):
                if w > 0:
                    inside[x.mark_at[r] : x.mark_at[r] + s - 1] += w
            for r, runs in x.runs:
                found = _weights(int(x.size[r]), x.scored(r, runs))
                post[x.first[r] : x.first[r + 1]] = found
                for (i, j), w in zip(runs, found):
                    inside[x.mark_at[r] + i : x.mark_at[r] + j] += w
            total: Counter = Counter()
            weight = post * x.n[x.row]
            many = np.zeros(len(post), bool)
            many[x.at] = True
            for r, w, t in zip(range(x.rows), _sums(weight * x.item, x.first), _sums(post * (x.item & ~many & (x.n == 1)[x.row]), x.first)):
                total[x.keys[r], 3, ""] += w
                total[x.keys[r], 4, ""] += t
            times = np.repeat(x.n, x.size - 1)
            for r, m, w, q in zip(np.repeat(np.arange(x.rows), x.size - 1).tolist(), x.marks, (times * (1 - inside)).tolist(), (times * inside).tolist()):
                total[x.keys[r], 1, m] += w
                total[x.keys[r], 2, m] += q
            h, place = np.unique(x.h, return_inverse=True)
            sums = np.bincount(place, weight[x.at], len(h))
            of = np.empty(len(h), object)
            of[place] = np.array(x.keys, object)[x.row[x.at]]
            k, n = list(total), len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*of.tolist(), *(y[0] for y in k)], pa.string()), pa.array([0] * len(h) + [y[1] for y in k], pa.int32()), pa.array([None] * len(h) + [y[2] for y in k], pa.string()),
                    pa.array([*h.tolist(), *[None] * n], pa.int64()), pa.array([*sums.tolist(), *total.values()], pa.float64()),
                ],
                names=["k", "what", "name", "h", "weight"],
            )

    return run


def _sums(values: np.ndarray, first: np.ndarray) -> list[float]:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).tolist()


def _decode(model: Model):
    """(k, lattice, items): the best path of each."""

    def run(batches):
        for b in batches:
            x = _Batch(b, model)
            texts, links = b.column("texts").to_pylist(), b.column("links").to_pylist()
            rows, atoms_, pairs, whole = x.regular()
            best, joined = [np.zeros(len(rows))], []
            for t in range(len(atoms_)):
                m = len(atoms_[t])
                f, two = best[t][:m] + atoms_[t], np.zeros(m, bool)
                if t:
                    g = best[t - 1][:m] + pairs[t - 1][:m]
                    two, f = g > f, np.maximum(f, g)
                best.append(f)
                joined.append(two)
            last, some = np.zeros(len(rows)), np.zeros(len(rows), bool)
            for t in range(len(atoms_)):
                last[: len(best[t + 1])] = best[t + 1]
                some[: len(joined[t])] |= joined[t]
            paths: dict[int, list[tuple[int, int]]] = {r: _best(int(x.size[r]), x.scored(r, runs)) for r, runs in x.runs}
            for at in np.flatnonzero(some | (whole > last)).tolist():
                n, path = int(x.size[rows[at]]), []
                if whole[at] > last[at]:
                    path = [(0, n - 1)]
                    n = 0
                while n:
                    two = bool(joined[n - 1][at])
                    path.append((n - 1 - two, n - 1))
                    n -= 1 + two
                paths[int(rows[at])] = sorted(path)
            items = [[t for t in own if t] for own in texts]
            for r, path in paths.items():
                items[r] = [y for y in (_whole(texts[r][i : j + 1], links[r][i:j]) for i, j in path) if y]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("lattice"), pa.array(items, pa.list_(pa.string()))], names=["k", "lattice", "items"])

    return run


def _letters(values: DataFrame) -> Letters:
    """Counts of the characters under each key: keys of the key table times the alphabet, whatever the number of rows."""

    def run(batches):
        for b in batches:
            held: dict[str, list[str]] = {}
            for k, packed in zip(b.column("k").to_pylist(), b.column("lattice").to_pylist()):
                held.setdefault(k, []).append(packed)
            out = [(k, c, n) for k, own in held.items() for c, n in Counter(_BREAK.join(["", *own])).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["k", "c", "n"])

    counts: dict[str, Counter] = {}
    for r in values.select("k", "lattice").mapInArrow(run, "k string, c string, n bigint").groupBy("k", "c").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["k"], Counter())[r["c"]] = r["n"]
    return Letters(counts)


def _met(lattice: DataFrame, shared: DataFrame, weights: DataFrame) -> DataFrame:
    """``lattice`` with ``at``, ``h``, ``w``: the segments whose items other values offer, and what these weigh there."""
    rows = shared.join(weights, "h").select("vid", F.struct("at", "h", F.greatest(F.col("weight") - F.col("own"), F.lit(0.0)).alias("w")).alias("s"))
    found = rows.groupBy("vid").agg(F.collect_list("s").alias("s")).select("vid", "s.at", "s.h", "s.w")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return lattice.join(found, "vid", "left").select(*[c for c in lattice.columns if c != "vid"], none("at", "array<int>"), none("h", "array<bigint>"), none("w", "array<double>"))


def _learn(lattice: DataFrame, chances: dict) -> tuple[Model, DataFrame, DataFrame]:
    """EM over ``lattice``: (model, the segments whose items several values offer, their items' weights)."""
    segs = lattice.select("vid", "k", "n", F.posexplode(F.arrays_zip("h", "same")).alias("at", "s")).filter("s.h IS NOT NULL").select("vid", "k", "at", F.col("s.h").alias("h"), F.col("n").cast("double").alias("n"), (F.col("n") * F.col("s.same")).cast("double").alias("own"), (F.lit(1.0) / F.col("s.same")).alias("one"))
    seen = materialize(segs.groupBy("h", "k").agg(F.round(F.sum("one")).alias("values"), F.sum("n").alias("weight")))
    model = Model(dict(chances))
    for r in seen.groupBy("k").agg(F.sum("weight").alias("items"), F.count(F.when(F.col("weight") == 1, 1)).alias("once")).collect():
        model.items[r["k"]], model.once[r["k"]] = r["items"], float(r["once"])
    several = seen.filter("values > 1").select("h", "weight")
    shared = materialize(segs.select("vid", "at", "h", "own").join(several.select("h"), "h", "left_semi"))
    weights, learned = several, seen
    rows = lattice.select("vid", "k", "n", "marks", "runs", "base")
    for _ in range(ROUNDS):
        expected = materialize(_met(rows, shared, weights).mapInArrow(_expect(model), "k string, what int, name string, h bigint, weight double").groupBy("k", "what", "name", "h").agg(F.sum("weight").alias("weight")))
        release(learned)
        learned = expected
        weights = learned.filter("what = 0").select("h", "weight")
        used: dict[tuple[str, str], list[float]] = {}
        items, once = Counter(), Counter()
        # keys of the key table, and below these times Unicode's punctuation marks
        for r in learned.filter("what > 0").collect():
            if r["what"] < 3:
                used.setdefault((r["k"], r["name"]), [0.0, 0.0])[r["what"] - 1] += r["weight"]
            else:
                (items if r["what"] == 3 else once)[r["k"]] += r["weight"]
        cut = Model.chances(used)
        moved = max((abs(p - model.chance(*x)) for x, p in cut.items() if x[1] not in HARD), default=0.0)
        model = Model(cut, items, once)
        if moved <= TOLERANCE:
            break
    weights._terrane_url = learned._terrane_url
    return model, shared, weights


def split_values(values: DataFrame) -> DataFrame:
    """(k, lattice, items array<string>) of each (k, lattice) of ``values`` (k, lattice, n bigint: its rows)."""
    letters = _letters(values)
    build = lambda rows, opened: materialize(rows.mapInArrow(_lattices(letters, opened), _LATTICE).withColumn("vid", F.monotonically_increasing_id()))
    lattice = build(values.select("k", "lattice", "n"), {})
    model, shared, weights = _learn(lattice, {})
    if opened := model.open_marks():
        longer = build(_met(lattice.select("vid", "k", "lattice", "n"), shared, weights).select("k", "lattice", "n", "at"), opened)
        if longer.filter(F.size("runs") > 0).isEmpty():
            release(longer)
        else:
            release(lattice, shared, weights)
            lattice = longer
            model, shared, weights = _learn(lattice, model.cut)
    return _met(lattice.drop("h", "same"), shared, weights).mapInArrow(_decode(model), "k string, lattice string, items array<string>")


def split_tags(tags: DataFrame, keys: DataFrame, least: int = 2) -> DataFrame:
    """(kind, id, k, pos, item) of each row of ``tags`` whose key is in ``keys`` (k, inner_chars) and whose value holds at least ``least`` items."""
    keys = keys.filter(F.col("k").isNotNull()).groupBy("k").agg(F.max("inner_chars").alias("inner"))
    named = tags.select(F.col("kind").cast("int").alias("kind"), "id", "k", "v").filter(F.col("v").isNotNull()).join(keys, "k").groupBy("kind", "id", "k", "v", "inner").agg(F.count(F.lit(1)).alias("n"))
    held = ["kind", "id", "k", "n"]
    kinds = dict(named.dtypes)
    rows = materialize(named.mapInArrow(_packed(held), ", ".join(f"{c} {kinds[c]}" for c in held) + ", lattice string"))
    values = materialize(rows.groupBy("k", "lattice").agg(F.sum("n").alias("n")))
    items = split_values(values).filter(F.size("items") >= least)
    return rows.select("kind", "id", "k", "lattice").join(items, ["k", "lattice"]).select("kind", "id", "k", F.posexplode("items").alias("pos", "item")).distinct()
