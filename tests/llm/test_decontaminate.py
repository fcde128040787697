import random
import re
import time
from itertools import combinations

import numpy as np

from siftwell.llm import decontaminate as d
from siftwell.llm.common import table
from tests.llm.helpers import documents, empty, prose, rows

BENCH = "item_id long, text string"


def cases():
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(15, 50))) for k in range(30)] + [(40, "too short"), (41, None), (42, ""), (43, prose(rng, 7))]
    items += [(44, "four wholly unheard words"), (45, "one of five rare things")]
    docs, want = [], set()
    for k in range(30):
        words = items[k][1].split()
        if k % 3 == 1:  # every sixth word another
            words[5::6] = ["otherword"] * len(words[5::6])
        if k % 3 == 2:
            words = words[: max(13, len(words) // 2 + 1)]
        docs.append((1000 + k, f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 40)}", "en", "a", 0))
        want.add((1000 + k, k))
    docs.append((2000, items[33][1].upper(), "en", "a", 0))
    want.add((2000, 43))
    docs += [(2002, "Too, short!", "en", "a", 0), (2003, f"{prose(rng, 9)} four wholly unheard words {prose(rng, 9)}", "en", "a", 0), (2004, f"{prose(rng, 9)} one of FIVE odd things {prose(rng, 9)}", "en", "a", 0)]
    want |= {(2002, 40), (2003, 44), (2004, 45)}
    docs.append((2005, f"{prose(rng, 9)} too short {prose(rng, 9)} four wholly odd words", "en", "a", 0))  # parts of short items
    docs.append((2001, " ".join(items[0][1].split()[:6]) + " " + prose(rng, 100), "en", "a", 0))  # a chance overlap
    return items, docs, want


def test_planted_passages_are_found_and_others_left(spark):
    items, docs, want = cases()
    df = documents(spark, rows() + docs + docs[:1])
    bench = spark.createDataFrame(items + items[:2], BENCH)
    hits = d.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == want
    assert sum(r.doc_id == 1000 for r in hits) == 2
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([r[0] for r in rows()] + [2001, 2005], key=str)


def test_joined_seeds_give_the_same(spark, monkeypatch):
    items, docs, want = cases()
    df, bench = documents(spark, rows() + docs + docs[:1]), spark.createDataFrame(items + items[:2], BENCH)
    sent = sorted(map(tuple, d.contaminated(df, bench).collect()))
    monkeypatch.setattr(d, "INDEX_WORDS", 100)
    assert not d.small(d.distinct_items(bench))
    assert sorted(map(tuple, d.contaminated(df, bench).collect())) == sent and {x[:2] for x in sent} == want
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([r[0] for r in rows()] + [2001, 2005], key=str)


def plain_overlaps(text, item):
    """Every ungapped alignment, every run of it: the rule as it is stated."""
    a, b = ([w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in (t or "").split()) if w] for t in (text, item))
    for shift in range(-len(b), len(a) + 1):
        equal = [0 <= k + shift < len(a) and a[k + shift] == w for k, w in enumerate(b)]
        if b and sum(equal) >= 0.8 * len(b) - 1e-9:
            return True
        inside = [k for k in range(len(b)) if 0 <= k + shift < len(a)]
        total = np.cumsum([0, *(5 * equal[k] - 4 for k in inside)])
        if any(total[j] - total[i] >= 0 for i in range(len(total)) for j in range(i + 13, len(total))):
            return True
    return False


def test_hits_equal_exhaustive_alignment(spark):
    rng = random.Random(21)
    few = [prose(rng, 1).strip(",.") for _ in range(40)]  # few words, so that chance overlaps abound
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.randint(7, 30)))) for k in range(12)]
    docs = []
    for k in range(60):
        words = [rng.choice(few) for _ in range(rng.randint(5, 80))]
        own = items[k % 12][1].split()
        a = rng.randint(0, len(own) - 1)
        piece = [rng.choice(few) if rng.random() < 0.2 else w for w in own[a : a + rng.randint(3, 30)]]
        at = rng.randint(0, len(words))
        docs.append((k, " ".join(words[:at] + piece + words[at:]), "en", "a", 0))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(documents(spark, docs), spark.createDataFrame(items, BENCH)).collect()}
    want = {(k, i) for k, text, *_ in docs for i, item in items if plain_overlaps(text, item)}
    assert got == want and 10 < len(want) < 300


def test_a_passage_that_repeats_a_few_words_takes_little(spark):
    period = "one two three four five "
    index, own = d.build_index([(1, period * 200), (2, "some other item of more than seven words here")]), d.Hashes()
    began = time.process_time()
    hits = d.overlaps(index, own, period * 2000)
    assert hits[0][2] == 1000 and 1 not in hits
    assert time.process_time() - began < 5


def test_query_equals_exhaustive_alignment(spark):
    data = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in d.op6_decontaminate(spark, data).collect()}
    docs, items = (table(spark, data, n).collect() for n in ("documents", "benchmark"))
    words = lambda t: {w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in (t or "").split()) if w}
    own = [(r.doc_id, r.text, words(r.text)) for r in docs if len((r.text or "").split()) < 120]
    some = {r[0] for r in own}
    # Pairs that share under six words can't overlap, unless one word repeats on and on.
    want = {(k, i.item_id) for i in items for k, t, w in own if len(w & words(i.text)) >= 6 and plain_overlaps(t, i.text)}
    assert {x for x in got if x[0] in some} == want and got


def test_empty_tables(spark):
    assert d.contaminated(documents(spark), empty(spark, BENCH)).count() == 0
    assert d.drop_contaminated(documents(spark), empty(spark, BENCH)).count() == len(rows())
    assert d.contaminated(empty(spark), spark.createDataFrame([(1, "one two three four five six")], BENCH)).count() == 0


def test_partial_quotes_with_substitutions_are_found(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, 60)) for k in range(12)]
    docs = []
    for k, (_, text) in enumerate(items):
        n = (13, 14, 20, 30)[k % 4]
        words = text.split()[10 : 10 + n]
        for at in (4, 9, 15, 22, 27)[: n // 5]:
            if at < n:
                words[at] = "otherword"
        docs.append((k, f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}", "en", "a", 0))
    df, bench = documents(spark, docs), spark.createDataFrame(items, BENCH)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()} == {(k, k) for k in range(12)}
    assert d.drop_contaminated(df, bench).count() == 0


def test_runs_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        equal = rng.random(rng.integers(1, 50)) < rng.choice([0.6, 0.75, 0.85])
        n = len(equal)
        want = max((b - a for a in range(n) for b in range(a + 13, n + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)), default=None)
        got = d.longest_run(equal)
        assert (got and got[1] - got[0]) == want
        assert got is None or 5 * equal[got[0] : got[1]].sum() >= 4 * want


def test_every_run_has_a_seed():
    for n, wrong in ((13, 2), (15, 3), (20, 4)):
        for at in combinations(range(n), wrong):
            equal = [k not in at for k in range(n)]
            assert any(all(equal[s + k] for k, bit in enumerate(m) if bit == "1") for m in d.MASKS for s in range(n - len(m) + 1)), at
