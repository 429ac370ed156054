"""Quality rules and decontamination."""

import hashlib
import random
import re
from collections import Counter

import pytest

from lodestone.llm import decontaminate, quality_rules
from nasty import nasty_rows


def repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def test_counts_by_hand(spark):
    r = random.Random(3)
    texts = ["", None, "a b c a b c", "a b a b a b a", "x # y\n\n* z\n* z\n \n", "é ß"] + [" ".join(r.choice("ab cd e".split()) for _ in range(r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in quality_rules.judge(df).collect():
        t = texts[row.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, t
        assert row.base_failed == (len(w) < 50 or 100 * repeats(w) > 50 * len(w))
        assert not (row.base_failed and row.kept)


def test_rules_keep_prose_and_drop_junk(spark):
    r = random.Random(1)
    prose = " ".join(r.choice(["the", "of", "house", "river", "and", "to", "walked", "morning", "quiet", "is"]) + r.choice(["", "", "s" * r.randint(0, 3)]) for _ in range(200))
    junk = " ".join(f"{w}***" for w in prose.split())
    got = [x.kept for x in quality_rules.judge(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [True, False]


def test_stop_words_are_those_of_the_language(spark):
    r = random.Random(2)
    text = lambda some: " ".join(r.choice([*some.split(), *(f"wort{k}" for k in range(40))]) for _ in range(300))
    en, de, it = text("the of and to in"), text("der die und mit nicht"), text("gli degli nella sono anche")
    rows = [(1, en, "en"), (2, de, "de"), (3, de, "en"), (4, it, "it"), (5, it, None), (6, it, "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality_rules.keep(df).collect()} == {1, 2, 4, 5}
    assert quality_rules.keep(df.drop("lang")).count() == 6


def test_quality_rules_on_odd_rows(nasty, nothing):
    assert quality_rules.judge(nasty.select("doc_id", "text")).count() == len(nasty_rows())
    left = quality_rules.keep(nasty)
    assert left.columns == nasty.columns and left.count() <= nasty.count()
    assert quality_rules.keep(nothing).count() == 0 and quality_rules.judge(nothing.select("doc_id", "text")).count() == 0


def test_plan_is_one_native_scan(nasty):
    plan = quality_rules.judge(nasty.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else None)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (who := grams.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= who
        ids = sorted(x for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(docs, items, **kw):
    rows = decontaminate.scan(docs, items, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in rows), key=repr)


@pytest.mark.parametrize("alphabet, block", [("abc", 100_000), ("ab", 7), ("abcdefghijkl", 50)])
def test_every_shared_window_is_found(spark, alphabet, block):
    r = random.Random(alphabet)
    docs = [(i, " ".join(r.choice(alphabet) for _ in range(r.choice([0, 3, 12, 13, 40, 200])))) for i in range(40)]
    items = [(i, " ".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 12, 13, 14, 30])))) for i in range(8)]
    items += [(50 + i, " ".join((docs[r.randrange(40)][1].split() * 2)[: r.choice([9, 13, 25])]).upper()) for i in range(8)] + [(None, docs[5][1]), (51, None)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ours(d, t, block=block) == brute(docs, items)
    assert ours(d, t, block=1, hashes=block) == brute(docs, items)


def test_work_grows_with_the_length_of_a_text(spark):
    """A text four times as long may take eight times as long at most, apart from what any query takes."""
    import time

    r = random.Random(1)
    item = [f"item{k}" for k in range(40)]
    t = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    took = []
    for n in (60_000, 240_000):
        words = [f"w{r.randrange(50_000)}" for _ in range(n)]
        words[n // 2 : n // 2] = item
        d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        runs = []
        for _ in range(2):
            began = time.time()
            assert [(x.n_words, x.n_hit) for x in decontaminate.scan(d, t).collect()] == [(n + 40, 40)]
            runs.append(time.time() - began)
        took.append(min(runs))
    assert took[1] <= 8 * took[0] + 2, took


def test_decontamination_of_odd_rows(spark, nasty, nothing):
    items = [(1, nasty_rows()[12][1] if nasty_rows()[12][1] else ""), (2, nasty_rows()[15][1]), (2, nasty_rows()[15][1]), (None, None)]
    t = spark.createDataFrame(items, "item_id long, text string")
    assert ours(nasty, t) == brute(nasty_rows(), items)
    left = decontaminate.decontaminate(nasty, t)
    bad = sum(1 for x in brute(nasty_rows(), items) if x[2] and 20 * x[2] >= x[1])
    assert left.columns == nasty.columns and left.count() == len(nasty_rows()) - bad and bad
    assert decontaminate.decontaminate(nasty, t.limit(0)).count() == len(nasty_rows())
    assert ours(nothing, t) == [] and decontaminate.decontaminate(nothing, t).count() == 0
    plan = decontaminate.scan(nasty, t)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
