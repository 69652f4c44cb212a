"""Filter overlaps against a plain version that applies every order to every document."""

import random
import re
from itertools import permutations

import pytest

from tessera.llm import interactions

DOCS = "doc_id long, text string, lang string, key string, part string, word string, `set` int"
LABELS = "doc_id long, quality int, toxic int, part string"


def frame(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, lang, "k", "p", "w", 3) for i, t, lang in rows], DOCS)


def plain(rows, labels):
    failed = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        failed.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                redundant = sum(f[1][x] and any(f[1][y] for y in order[: step - 1]) for f in own)
                unique = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                steps.append([part, "".join(order), step, len(left), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone)])
        out += [(*s, sum(t[4] for t in steps if t[1][t[2] - 1] == s[1][s[2] - 1])) for s in steps]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(5)
    words = [a + b for a in ("ba", "ko", "Mi", "zu") for b in ("la", "to", "né", "", "x#", "|")]
    rows = [(k, " ".join(rng.choice(words[: rng.randint(2, 24)]) + (str(j) if k % 3 else "") for j in range(rng.choice((3, 150, 199, 200, 201, 260)))), rng.choice(("it", "en", "", None))) for k in range(60)]
    rows += [(100 + k, rows[k % 3][1], "it") for k in range(8)]
    rows += [(100, rows[0][1], "it")] * 3 + [(5, "other", "en"), (90, None, "it"), (91, "", "en"), (92, "", None), (None, rows[1][1], "en"), (None, None, None), (93, " \n\t", "it"), (94, "a b c A" * 9000, "en")]
    labels = [(k, k % 2, k % 3 == 0, "z") for k in range(0, 110, 2)] + [(1, 1, None, "z"), (1, 0, 1, "z"), (None, 1, 1, "z"), (4, None, None, "z")]
    found = interactions.audit(frame(spark, rows), spark.createDataFrame([(i, q, None if t is None else int(t), z) for i, q, t, z in labels], LABELS))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expected = plain(rows, labels)
    assert sorted(tuple(r) for r in found.collect()) == expected and len(expected) == 3 * 600
    assert sum(e[7] for e in expected) and sum(e[8] for e in expected) and sum(e[6] for e in expected)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1, "z")]])
def test_empty_tables(spark, labels):
    none = frame(spark, [(1, "x", "it")]).limit(0)
    assert interactions.audit(none, spark.createDataFrame(labels, LABELS)).count() == 0
    one = interactions.audit(frame(spark, [(1, "x", "it")]), spark.createDataFrame(labels, LABELS))
    assert one.count() == 600 and one.where("removed > 0").count() == 120  # only A fails
    assert {r.good_lost for r in one.where("removed > 0").collect()} == {len(labels)}
