from pyspark.sql import functions as F

from quire.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tx.ascii_tokens(F.col("t")), t="Über-Café 12,5% x_y") == ["ber", "caf", "12", "5", "x", "y"]
    assert one(spark, tx.query_terms(F.col("t")), t="Über x_y 5") == ["Über", "x_y", "5"]
    assert one(spark, tx.word_count(F.col("t")), t="a b\tc\nd") == 4
    assert one(spark, tx.word_count(F.col("t")), t="") == 0
    assert one(spark, tx.paragraphs(F.col("t")), t=" a\nb \n \n\n c\n\n") == ["a\nb", "c"]


def test_normal_forms(spark):
    assert one(spark, tx.entity_form("t"), t="  EXAMPLE Ltd  ") == "example ltd"
    assert one(spark, tx.compatibility_form("t"), t="  Share‑based\nPAYMENTS  ") == "Share‐based PAYMENTS"
    assert one(spark, tx.normalized(F.col("t")), t="Straße, No. 5!") == "strasse no 5"
    assert one(spark, tx.slug(F.col("t")), t="  Hybrid (RRF) 0.5 ") == "hybrid-rrf-0-5"
    assert one(spark, tx.base_name(F.col("t")), t="a/b\\c.pdf") == "c.pdf"
    assert one(spark, tx.base_name(F.col("t")), t="a/ ") is None


def test_numbers(spark):
    assert one(spark, tx.numbers(F.col("t")), t="-4.59 and 5-3, x12 v1.2 1,234.5") == [-4.59, 5.0, 3.0, 1234.5]
    assert one(spark, tx.close_numbers(F.col("a"), F.col("b")), a=100.05, b=100.0) is True
    assert one(spark, tx.close_numbers(F.col("a"), F.col("b")), a=100.2, b=100.0) is False


def test_contains_tokens(spark):
    assert one(spark, tx.contains_tokens(F.col("a"), F.col("b")), a=["x", "0", "9", "million"], b=["0", "9", "million"]) is True
    assert one(spark, tx.contains_tokens(F.col("a"), F.col("b")), a=["10", "9"], b=["0", "9"]) is False


def test_word_edits(spark):
    assert one(spark, tx.word_edits("a", "b"), a="revenue rose", b="revenue has risen") == 2
    assert one(spark, F.levenshtein("a", "b"), a="kitten", b="sitting") == 3


def test_labels(spark):
    assert one(spark, tx.page_label(F.col("a"), F.col("b")), a=2, b=3) == "Pages 2-3"
    assert one(spark, tx.human_size(F.col("a")), a=2048) == "2.0 KB"


def test_stemmer_against_the_full_text_engine():
    import sqlite3

    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll expenses administrative liabilities amortisation generalizations oscillators".split()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
        db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    except sqlite3.OperationalError:
        import pytest

        pytest.skip("no full-text engine here")
    for word in words:
        db.execute("DELETE FROM f")
        db.execute("INSERT INTO f VALUES (?)", (word,))
        assert db.execute("SELECT term FROM v").fetchone()[0] == tx.porter_stem(word), word
