import brute

from episcope.llm import pii

HARD = [
    (1, None), (2, ""), (3, "a@b.com_x@y.co.uk and x.y+z@sub-domain.example.com, @no a@b"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3"),
    (5, "4539 1488 0343 6467 and 4539-1488-0343-6467, 4539148803436468; 79927398713"), (6, "+1 (555) 555-0199 ++49 30 1234567 +12 +1234567890123456"),
    (7, "é🙂 a@b.de 🙂 +49 30 1234567 10.0.0.1"), (7, "é🙂 a@b.de 🙂 +49 30 1234567 10.0.0.1"), (None, "z@z.zz"),
    (8, " ".join(f"u{i}@m.org {i % 300}.1.2.3" for i in range(900))), (9, "1" * 60000 + "@" + "1 " * 30000), (10, "a" * 200000),
    (11, "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001; call (555) 123-4567 or see 555-123-4567"), (12, "+1(((((" + "(" * 50000),
]
COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def compare(docs):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in pii.personal_data_digest(docs).collect()]
    expected = [(r["doc_id"], *brute.pii_row(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_hard_texts(spark):
    compare(spark.createDataFrame([(i, t, "x") for i, t in HARD], "doc_id long, text string, spans string"))


def test_whole_table(spark, sf_dir):
    compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_checksums_and_context_add_spans(spark):
    docs = spark.createDataFrame([HARD[-2], (13, "555-123-4567")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data_digest(docs).collect()}
    text = HARD[-2][1]
    assert f"iban:5:{5 + 27}" in spans[11] and spans[11].count("iban") == 1
    assert f"local_phone:{text.index('(555)')}:{text.index('(555)') + 14}" in spans[11]
    assert "local_phone" not in spans[13]


def test_empty_and_native(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    frame = pii.personal_data_digest(empty)
    assert frame.count() == 0
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_account_number_before_a_capital_or_a_digit(spark):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"]
    behind = [" Please pay", " BIC COBADEFF", " 2024 and", " A", "", "; so"]
    texts = [f"IBAN {n}{b}" for n in numbers for b in behind]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data_digest(docs).collect()}
    for i, text in enumerate(texts):
        n = numbers[i // len(behind)]
        assert f"iban:5:{5 + len(n)}" in spans[i], text
