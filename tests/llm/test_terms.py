from collections import Counter

import numpy as np

from tilewright.llm import terms


def frames(spark, classes, edits):
    data = spark.createDataFrame([(i, c, "x", 1) for i, c in enumerate(classes)], "row_id long, seg_class string, field string, records int")
    e = spark.createDataFrame([(i, f, t, "x") for i, (f, t) in enumerate(edits)], "edit_id long, from_class string, to_class string, term string")
    return data, e


def brute(columns):
    out, marks = set(), set()
    for field, values in columns.items():
        occ, rec = Counter(), Counter()
        some = [v.upper().split() for v in values if v is not None and v.split()]
        for w in some:
            occ.update(w)
            rec.update(set(w))
        for t in occ:
            rare, common = rec[t] <= 2, rec[t] >= 0.2 * len(some)
            out.add((field, t, occ[t], rec[t], rare, common))
            marks |= {(field, t, m) for m, yes in (("rare", rare), ("common", common)) if yes}
    return out, marks


def test_brute_force(spark):
    rng = np.random.default_rng(0)
    pick = lambda k: " ".join(rng.choice(["a", "B", "b", "Ärger", "straße", "x1", "zz", "qq7"], k, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.04, 0.01]))
    classes = [None, "", " \t\n", " a　b", "c " * 20_000, *(pick(int(rng.integers(0, 6))) for _ in range(300))]
    edits = [(pick(int(rng.integers(0, 4))), None if i % 7 == 0 else pick(1)) for i in range(200)]
    data, e = frames(spark, classes, edits + edits[:20])
    every, marks = brute({"seg_class": classes, "from_class": [a for a, _ in edits + edits[:20]], "to_class": [b for _, b in edits + edits[:20]]})
    assert {tuple(r) for r in terms.p5_terms(data, e).collect()} == every
    assert {tuple(r) for r in terms.p5_found(data, e).collect()} == marks


def test_empty(spark):
    data, e = frames(spark, [], [])
    assert terms.p5_terms(data, e).collect() == [] and terms.p5_found(data, e).collect() == []
    data, e = frames(spark, [None, " "], [])
    assert terms.p5_found(data, e).collect() == []
