import random
import time

from terrane.operators import multivalue as mv

KEYS = [("sport", "word", "_"), ("place", "place", "-.'"), ("hours", "hours", ",-:"), ("none", "word", None), (None, "word", "")]


def run(spark, rows, keys=KEYS, least=1):
    t = spark.createDataFrame([(*r, "z") for r in rows], "kind tinyint, id bigint, k string, v string, inner string")
    k = spark.createDataFrame(keys, "k string, item_kind string, inner_chars string")
    out = {}
    for r in mv.split_tags(t, k, least).collect():
        out.setdefault((r.kind, r.id, r.k), {})[r.pos] = r.item
    return {key: [v[i] for i in range(len(v))] for key, v in out.items()}


CASES = [
    ("sport", "a;b", ["a", "b"]),
    ("sport", " a ;; b ;", ["a", "b"]),
    ("sport", "a, b；c、d|e/f•g，h", list("abcdefgh")),
    ("sport", "a\tb\nc\r\nd", list("abcd")),
    ("sport", "table_ball; x y", ["table_ball", "x y"]),
    ("place", "St. Terton;L'Velhaldal,Ori-Mor", ["St. Terton", "L'Velhaldal", "Ori-Mor"]),
    ("place", '"A; B" ; “C, D”;\'E/F\'', ["A; B", "C, D", "E/F"]),
    ("place", 'A\\, B;C', ["A, B", "C"]),
    ("place", '"A, old ""B"" yard";C', ['A, old "B" yard', "C"]),
    ("place", "“A, old \"B\" yard”;C", ['A, old "B" yard', "C"]),
    ("place", "'L'Halstad; X';b", ["L'Halstad; X", "b"]),
    ("place", '5" pipe;x', ['5" pipe', "x"]),
    ("place", '"open; x', ['"open', "x"]),
    ("hours", "Mo,Tu 07:00-19:30; Sa 1:00", ["Mo,Tu 07:00-19:30", "Sa 1:00"]),
    ("none", "a;b", ["a", "b"]),
    ("sport", ";,", []),
    ("sport", "", []),
    ("sport", '""', []),
    ("sport", "a\\", ["a\\"]),
]


def test_cases(spark):
    rows = [(0, i, k, v) for i, (k, v, _) in enumerate(CASES)]
    got = run(spark, rows)
    for i, (k, v, want) in enumerate(CASES):
        assert got.get((0, i, k), []) == want, v


def test_rows(spark):
    rows = [(0, 1, "sport", "a;b"), (0, 1, "sport", "a;b"), (0, 2, "sport", None), (0, 3, None, "a;b"), (0, 4, "other", "a;b"), (1, 1, "sport", "one")]
    assert run(spark, rows, least=2) == {(0, 1, "sport"): ["a", "b"]}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(0, 1, "sport", "a;b")], keys=[]) == {}


def test_very_long_value(spark):
    v = ";".join(f"item{i}" for i in range(20_000))
    began = time.time()
    got = run(spark, [(0, 1, "sport", v)])[(0, 1, "sport")]
    assert len(got) == 20_000 and got[-1] == "item19999" and time.time() - began < 60


def test_unknown_mark_is_learned(spark):
    """'+' parts frequent items, but not the halves of a name that are no items."""
    rows = [(0, i, "sport", x) for i, x in enumerate(["chess", "golf"] * 200)] + [(1, 1, "sport", "chess+golf"), (1, 2, "sport", "rock+roll")] + [(1, 10 + i, "sport", "rock+roll") for i in range(40)]
    got = run(spark, rows)
    assert got[(1, 1, "sport")] == ["chess", "golf"] and got[(1, 2, "sport")] == ["rock+roll"]


def test_items_of_several_unknown_marks_are_kept_as_they_stand(spark):
    rows = [(0, i, "sport", x) for i, x in enumerate(["chess", "golf", "judo"] * 200)] + [(1, i, "sport", x) for i, x in enumerate(["rock-n-roll", "1.2.3.4", "hide - seek ;golf"] * 40)] + [(2, 1, "sport", "chess+golf+judo")]
    got = run(spark, rows)
    assert [got[(1, i, "sport")] for i in range(3)] == [["rock-n-roll"], ["1.2.3.4"], ["hide - seek", "golf"]]
    assert got[(2, 1, "sport")] == ["chess", "golf", "judo"]
    assert mv.segments(*mv.atoms('a -  b+ "c d" -e', ""))[3] == (0, 3, "a -  b+ c d -e")


def test_path_against_all_segmentations():
    import itertools
    import math

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 6)
        texts, marks = [rng.choice("abc") for _ in range(n)], [rng.choice(";+") for _ in range(n - 1)]
        segs = mv.segments(texts, marks)
        probs = [rng.random() for _ in segs]
        cut = {";": 0.8, "+": 0.4}
        score = {(i, j): mv._score(i, j, p, marks, cut) for (i, j, _), p in zip(segs, probs)}
        paths = []
        for cuts in itertools.product([0, 1], repeat=n - 1):
            ends = [i for i, c in enumerate(cuts) if c] + [n - 1]
            path = list(zip([0] + [e + 1 for e in ends[:-1]], ends))
            if all(p in score for p in path):
                paths.append((sum(score[p] for p in path), path))
        assert mv.viterbi(len(texts), marks, segs, probs, cut) == max(paths)[1]
        total = sum(math.exp(s) for s, _ in paths)
        for (i, j, _), w in zip(segs, mv.posteriors(len(texts), marks, segs, probs, cut)):
            assert abs(w - sum(math.exp(s) for s, p in paths if (i, j) in p) / total) < 1e-9


def plain(v, inner=""):
    return [x for x in mv.atoms(v, inner)[0] if x]


def test_a_mark_is_inner_by_use(spark):
    """Nothing but the column says that ';' belongs to items of one key and parts those of another; '/' parts both."""
    names = ["north;side", "east;end", "old;town", "west;bank", "lake;view"]
    rows = [(0, i, "sport", names[i % 5]) for i in range(200)] + [(1, i, "sport", f"{names[i % 5]}/{names[(i + i // 5) % 5]}") for i in range(60)]
    rows += [(2, i, "place", ["alder", "birch", "cedar"][i % 3]) for i in range(150)] + [(3, i, "place", "alder;birch/cedar") for i in range(5)] + [(4, 1, "place", "cedar;alder"), (4, 2, "place", "birch;cedar")]
    got = run(spark, rows)
    assert got[(0, 1, "sport")] == ["east;end"] and got[(1, 11, "sport")] == ["east;end", "west;bank"]
    assert got[(3, 0, "place")] == ["alder", "birch", "cedar"] and got[(4, 1, "place")] == ["cedar", "alder"]
    assert any(got[i, n, k] != plain(v) for i, n, k, v in rows)


def test_item_of_four_atoms_inside_a_list(spark):
    rows = [(0, i, "sport", ["well-to-do-x", "golf", "judo"][i % 3]) for i in range(150)] + [(1, i, "sport", x) for i, x in enumerate(["golf;well-to-do-x", "well-to-do-x;judo;golf", "judo/well-to-do-x", "golf;judo", "judo/golf"])]
    got = run(spark, rows)
    assert [got[(1, i, "sport")] for i in range(5)] == [["golf", "well-to-do-x"], ["well-to-do-x", "judo", "golf"], ["judo", "well-to-do-x"], ["golf", "judo"], ["judo", "golf"]]


def test_flat_arrays_against_single_lattices():
    """The passes over flat arrays of a batch give what the ones over one lattice give."""
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(5)
    values = [("sport", "".join(rng.choice(["a", "b", "cd", ";", "+", "; ", "\t", "-"]) for _ in range(rng.randint(1, 12)))) for _ in range(200)]
    packed = [mv._pack(*mv.atoms(v, "")) for _, v in values]
    letters = mv.Letters({"sport": Counter(mv._BREAK.join(["", *packed]))})
    model = mv.Model({("sport", ";"): 0.8, ("sport", "+"): 0.3, ("sport", "-"): 0.5}, {"sport": 50.0}, {"sport": 20.0})
    rows = pa.RecordBatch.from_arrays([pa.array([k for k, _ in values]), pa.array(packed), pa.array([rng.randint(1, 3) for _ in values], pa.int64())], names=["k", "lattice", "n"])
    lattice = next(mv._lattices(letters, {"sport": frozenset("-")})([rows]))
    at = [[i for i, x in enumerate(h) if x is not None and i % 2] for h in lattice.column("h").to_pylist()]
    met = {"at": pa.array(at, pa.list_(pa.int32())), "h": pa.array([[h[i] for i in own] for h, own in zip(lattice.column("h").to_pylist(), at)], pa.list_(pa.int64())), "w": pa.array([[0.25 * i for i in own] for own in at], pa.list_(pa.float64()))}
    names = [c for c in lattice.schema.names if c != "h"]
    batch = pa.RecordBatch.from_arrays([*(lattice.column(c) for c in names), *met.values()], names=[*names, *met])
    x = mv._Batch(batch, model)
    want: Counter = Counter()
    items = []
    for r, row in enumerate(batch.to_pylist()):
        n = len(row["texts"])
        segs = [(s["i"], s["j"]) for s in row["runs"]] or [(i, i) for i in range(n)] + [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)] * (n > 2)
        order = sorted((a for a, (i, j) in enumerate(segs) if i == j or row["base"][a] is not None), key=lambda a: segs[a])
        scored = [x.scored(r, segs)[a] for a in order]
        for a, w in zip(order, mv._weights(n, scored)):
            if row["base"][a] is not None:
                want[3, ""] += w * row["n"]
                want[4, ""] += w * (row["n"] == 1 and a not in row["at"])
            for m in row["marks"][segs[a][0] : segs[a][1]]:
                want[2, m] += w * row["n"]
            if a in row["at"]:
                want[0, row["h"][row["at"].index(a)]] += w * row["n"]
        items.append([y for y in (mv._whole(row["texts"][i : j + 1], row["links"][i:j]) for i, j in mv._best(n, scored)) if y])
    got: Counter = Counter()
    for r in next(mv._expect(model)([batch])).to_pylist():
        got[r["what"], r["h"] if r["what"] == 0 else r["name"]] += r["weight"]
    for key, w in want.items():
        assert abs(got[key] - w) < 1e-6, key
    assert next(mv._decode(model)([batch])).column("items").to_pylist() == items
