import random

from hypothesis import given, settings
from hypothesis import strategies as st

from episcope.llm import decontamination as d

WORDS = "the of thing ere anion ble stor hea ning ould wer tion ant ist".split()


def nearest(item, text):
    """Fewest edits between ``item`` and any substring of ``text``, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@given(st.text("abc ", min_size=1, max_size=40), st.text("abc ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_bit_vectors_give_the_table_s_distance(item, text):
    found = d.Pattern(item).best(text, len(item))
    assert (found[0] if found else len(item)) == nearest(item, text)


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(chars) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


def test_nothing_within_the_budget_is_lost():
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [d.plain(prose(rng.randint(1, 20))) for _ in range(25)]
    matcher = d.Matcher(items, 0.1)
    for _ in range(150):
        item = rng.choice(items)
        text = d.plain(prose(10) + edited(item, rng.randint(0, int(len(item) * 0.12)), rng) + prose(10))
        found = {n: dist for n, (dist, _) in matcher.find(text).items()}
        for number, each in enumerate(items):
            distance = nearest(each, text)
            if distance <= int(len(each) * 0.1):
                assert number in found
            else:
                assert number not in found


def test_tables(spark):
    item = "Some test item, with quite a few words in it. And another sentence"
    docs = [
        (1, None, "x"), (2, "", "x"), (3, f"before {item.upper()} after", "x"), (3, f"before {item.upper()} after", "x"),
        (4, item.replace("quite a few", "quiet a few"), "x"), (5, "nothing of that kind " * 3000, "x"), (None, item, "x"),
        (6, ("long words " * 30000) + item, "x"), (7, "Some test item, with other words", "x"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item.lower()), (5, "--")], "item_id long, text string")
    for block in (1, 2_000_000):
        got = d.benchmark_matches(docs, items, block_chars=block).collect()
        rows = sorted((r["doc_id"] or -1, r["item_id"], r["distance"] > 0) for r in got)
        expected = [(-1, False), (3, False), (3, False), (4, True), (6, False)]
        assert rows == sorted((i, n, e) for i, e in expected for n in (1, 4))
        kept = d.without_benchmark(docs, items, block_chars=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7]
        assert kept.columns == docs.columns
    none = items.limit(0)
    assert d.benchmark_matches(docs, none).count() == 0 and d.without_benchmark(docs, none).count() == 9
    assert d.benchmark_matches(docs.limit(0), items).count() == 0


def test_query_finds_exact_copies(spark, sf_dir):
    from episcope.llm import queries

    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, sf_dir).collect()}
    docs = [(r["doc_id"], d.plain(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], d.plain(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = {(i, n) for i, text in docs for n, item in items if item in text}
    assert exact and exact <= got
    assert all(nearest(dict(items)[n], dict(docs)[i]) <= len(dict(items)[n]) // 10 for i, n in sorted(got - exact)[:5])
