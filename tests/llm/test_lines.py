import re

from pyspark.sql import functions as F

from episcope.llm import line_templates as lt

SCHEMA = "doc_id long, text string, n_dropped string, _key string"


def tokens(line):
    return ["<*>" if re.search("[0-9]", w) else w for w in re.split(r"[ \t\r\x0b\f]+", line.strip(" "))]


BARS = ((20, 3), (8, 5))  # tokens, documents


def plain_version(texts, min_documents, class_of=None, similarity=0.7, min_tokens=3, min_chars=16):
    """The same decisions with dictionaries. ``class_of`` gives the class of a text, its own if left out."""
    class_of = class_of or (lambda text: text)
    leaf = lambda x: (len(x), tuple(x[:3]))
    leaves, holding = {}, {}
    for text in {t for t in texts if t is not None}:
        for raw in text.split("\n"):
            x = tokens(raw)
            if len(raw.strip(" ")) >= min_chars and len(x) >= min_tokens:
                leaves.setdefault(leaf(x), {}).setdefault(tuple(x), set()).add(class_of(text))
                holding.setdefault(leaf(x), set()).add(text)
    dropped = set()
    for where, bodies in leaves.items():
        bar = next((min(d, min_documents) for n, d in BARS if where[0] >= n), min_documents)
        left = dict(bodies) if len(holding[where]) >= bar else {}
        while left:
            # Leaders of a leaf are taken one by one: most documents first.
            most = max(len(c) for c in left.values())
            leader = min((b for b in left if len(left[b]) == most), key=body_hash)
            rest = range(3, len(leader))
            group = [b for b in left if sum(b[i] == leader[i] for i in rest) >= similarity * len(rest)]
            if len(set().union(*(left[b] for b in group))) >= bar:
                dropped |= set(group)
            for b in group:
                del left[b]
    out = []
    for text in texts:
        lines = [] if text is None else text.split("\n")
        keep = [x for x in lines if tuple(tokens(x)) not in dropped or len(x.strip(" ")) < min_chars]
        out.append((None if text is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def body_hash(body):
    """Bodies that stand in equally many documents lead in the order of their hashes; here, of any fixed text."""
    return HASHES.get(body, 0)


HASHES = {}


def sample():
    texts = []
    for i in range(60):
        body = [f"alpha{chr(97 + i % 26)}{chr(97 + i // 26)} beta gamma words of document {chr(97 + i % 7)}{chr(97 + i % 11)}" for _ in range(2)]
        lines = [body[0], f"  Served at 10:0{i % 10} by host-{i} for you ", body[1] + " end"]
        if i % 3 == 0:
            lines.insert(1, "This site uses the cookies of our great partners")
        if i % 4 == 0:
            lines.append("short one")
        texts.append("\n".join(lines))
    texts += [texts[1]] * 40 + [None, "", "\n\n", "one line only, and a rather long one at that\n" * 3000]
    return texts


def test_templates_against_plain_version(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[0], "x", "y")], SCHEMA)
    got = lt.drop_recurring_lines(docs, min_documents=8)
    assert [c for c in got.columns if c != "text"] == ["doc_id", "_key", "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in got.collect()}
    expected = plain_version([*texts], 8)
    for i, want in enumerate(expected):
        assert (rows[i]["text"], rows[i]["n_lines"], rows[i]["n_dropped"]) == want, i
    assert "cookies" not in rows[0]["text"] and "Served" not in rows[5]["text"]
    assert rows[None]["text"] == rows[0]["text"]
    # a document copied 41 times keeps its own words
    assert "alpha" in rows[1]["text"]


def test_whole_table_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    classes = {r["id"]: r["label"] for r in lt.near_copies(docs).collect()}
    rows = sorted((r["doc_id"], r["text"], r["id"]) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("id")).collect())
    label = {t: classes.get(i, i) for _, t, i in rows}
    parsed = lt._lines(docs, "text", 3, 16).select("body", "line").distinct().collect()
    HASHES.update({tuple(tokens(r["line"])): r["body"] for r in parsed})
    for least in (5, 20):
        got = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in lt.drop_recurring_lines(docs, min_documents=least).collect())
        expected = plain_version([t for _, t, _ in rows], least, label.get)
        assert sum(x[2] for x in got) > 0
        assert [i for (i, t, _), (want, *_rest) in zip(got, expected, strict=True) if t != want] == []


def test_near_copies_are_found(spark, sf_dir):
    """Recall and precision of the links' classes; one text a band is compared, so some links are lost."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    classes = {r["id"]: r["label"] for r in lt.near_copies(docs).collect()}
    ids = {r["text"]: r["id"] for r in docs.select("text", F.xxhash64("text").alias("id")).distinct().collect()}
    of = plain_classes([t for t in ids if t is not None])
    kinds = sorted(of)
    together = lambda a, b: classes.get(ids[a], ids[a]) == classes.get(ids[b], ids[b])
    pairs = [(a, b) for n, a in enumerate(kinds) for b in kinds[:n] if of[a] == of[b]]
    assert sum(together(a, b) for a, b in pairs) >= 0.85 * len(pairs)
    found = [(a, b) for n, a in enumerate(kinds) for b in kinds[:n] if together(a, b)]
    assert sum(of[a] == of[b] for a, b in found) >= 0.9 * len(found)


def test_empty_and_native(spark):
    empty = spark.createDataFrame([], SCHEMA)
    frame = lt.drop_recurring_lines(empty)
    assert frame.count() == 0
    assert "Python" not in frame._jdf.queryExecution().toString()


def prose(i, k):
    """Forty words that only line k of text i has."""
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(40))


def test_every_line_of_a_shared_block_counts_documents(spark):
    block = ["Contact our friendly office today", "Every word here is reserved", "Imprint and privacy of partners"]
    texts = ["\n".join([prose(i, 0), prose(i, 1), *block]) for i in range(25)]
    # near copies of one text, each with another line before the closing one, are one document
    texts += ["\n".join([*(prose(90, k) for k in range(12)), f"Edit {prose(100 + i, 0)[:20]}", "Closing line of one text"]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(docs, min_documents=20).collect()}
    for i, text in enumerate(texts):
        assert rows[i] == ("\n".join(text.split("\n")[:2]) if i < 25 else text), i


def plain_classes(texts):
    """The smallest text of each text's class: texts whose sets of word pairs are alike are linked."""
    kinds = sorted({t for t in texts if t is not None})
    words = [t.split() or [""] for t in kinds]
    sets = [set(zip(w, [*w[1:], None], strict=True)) for w in words]
    label = list(range(len(kinds)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {t: label[i] for i, t in enumerate(kinds)}


def test_dropped_lines_stand_in_enough_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    left = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(docs, min_documents=5).collect()}
    of, where = plain_classes(rows.values()), {}
    for text in of:
        for line in text.split("\n"):
            if len(line.strip(" ")) >= 16 and len(tokens(line)) >= 3:
                where.setdefault(line, set()).add(of[text])
    frequent = {line for line, found in where.items() if len(found) >= 5}
    assert len(frequent) > 5
    assert not any(frequent & set(t.split("\n")) for t in left.values() if t is not None)
    # stands in four documents, but in five surroundings
    assert any("Beverbe in dieentzäsch ä enßst enge er die." in (t or "").split("\n") for t in left.values())


def test_long_lines_with_production_parameters(spark):
    import corpus_pipeline

    long, middle, short = prose(200, 0) + prose(201, 0), prose(202, 0)[:80], "Chance repeats this"
    texts = ["\n".join([prose(i, 0), prose(i, 1), prose(i, 2), long, middle, short]) for i in range(3)]
    texts += ["\n".join([prose(i, 0), prose(i, 1), middle, short]) for i in range(3, 6)]
    # near copies of one text keep their lines
    texts += ["\n".join([f"Edit{chr(97 + i)} {prose(50, 0)}", *(prose(50, k) for k in range(1, 9))]) for i in range(6)]
    expected = ["\n".join(x for x in t.split("\n") if x not in (long, middle)) for t in texts]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    for i, text in enumerate(expected):
        assert rows[i] == text, i


def test_every_family_of_a_leaf(spark):
    words = [[f"{chr(97 + f)}{chr(97 + k)}" for k in range(5)] for f in range(18)]
    line = lambda i: " ".join([f"2024-01-{i:03}", f"10:{i}", f"{i}", *words[i % 18], f"var{chr(97 + i // 18)}"])
    texts = ["\n".join([prose(i, 0), line(i), prose(i, 1)]) for i in range(18 * 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["n_dropped"] for r in lt.drop_recurring_lines(docs, min_documents=6).collect()} == {1}


ODD = [
    "", " ", "\n", " \n\n a", "one two three four five", "  led by blanks and two  inside ", "tab\tand\x0bform\ffeed\rreturn and more words",
    "\tstarts with a tab 10:30 x9y z ", "unit 7 of 12", "a\u00a0b c\u2003d e f g h", "grüße an 3 ß²  Wörter ٣ x", "last line\n", "x " * 300,
    " ".join(f"p{i % 3}" for i in range(400)), " ".join(chr(97 + i % 26) * (1 + i // 26) for i in range(200)),
    " ".join(["same", "pair"] * 150 + [chr(97 + i) for i in range(20)]), "a\n b\nc \n\nd\te", None,
]


def test_tokens_and_sketches_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    masked = F.regexp_replace("line", r"(?<!\S)[^\s0-9]*+[0-9]\S*+", lt.VARIABLE)
    plain = F.split(F.trim(F.when(F.rlike("line", F.lit("[0-9]")), masked).otherwise(F.col("line"))), r"[ \t\r\x0b\f]+")
    for r in lines.select("line", plain.alias("want"), lt._tokens(F.col("line")).alias("got")).collect():
        assert r["got"] == r["want"], r
    words = docs.filter("text is not null").select(F.xxhash64("text").alias("id"), F.split(F.trim("text"), r"\s+").alias("words"))
    pairs = F.transform("words", lambda word, i: F.xxhash64(word, F.get("words", i + 1)))
    want = words.select("id", F.slice(F.sort_array(F.array_distinct(pairs)), 1, lt.SKETCH).alias("sketch"))
    assert sorted(lt._sketches(docs, "text").collect()) == sorted(want.collect())


def test_lines_are_parsed_in_generated_code(spark, monkeypatch):
    """No function over arrays takes part, which would run outside generated code and per element."""
    plans = []
    monkeypatch.setattr(lt, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert lt._lines(docs, "text", 3, 16).count() > 0
    assert "lambdafunction" not in plans[0] and plans[0].count("xxhash64(") and plans[0].count("regexp_replace(") == 1
