import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions.stemming import stem


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("question, want", [('-foo "bar" and baz OR', "foo OR bar OR baz"), ("", ""), ("++a -b or", "a OR b")])
def test_or_query(spark, question, want):
    assert one(spark, tx.or_query(F.col("q")), q=question) == want


@pytest.mark.parametrize("raw, want", [("a, b.md,c.MD, d", ["a, b.md", "c.MD", "d"]), ("", []), (" x.md ,, y.md", ["x.md", "y.md"])])
def test_file_list(spark, raw, want):
    assert one(spark, tx.split_file_list(F.col("q")), q=raw) == want


@pytest.mark.parametrize("raw, want", [("12 § X, 13 § Y; Z", ["12 § X", "13 § Y", "Z"]), ("Pay, holidays", ["Pay, holidays"]), ("a|b", ["a", "b"])])
def test_sections(spark, raw, want):
    assert one(spark, tx.split_sections(F.col("q")), q=raw) == want


@pytest.mark.parametrize("raw, want", [("KV / III luku Työaika", ["työaika"]), ("1.1 ja tai", []), ("a/b/Xyz Xyz 12", ["xyz"])])
def test_heading_tokens(spark, raw, want):
    assert one(spark, tx.heading_tokens(F.col("q")), q=raw) == want


@pytest.mark.parametrize("a, b, want", [
    ("32. § Short time", "37. § Short time", False),
    ("Luku 1.1 Palkkakäsite", "Palkkakäsite", True),
    ("alpha beta gamma", "alpha beta delta omega sigma", True),
    ("alpha beta gamma delta", "alpha beta kappa omega", False),
    ("36 § Pay", "§ 36 Pay", True),
    ("", "Pay", False),
])
def test_headings_match(spark, a, b, want):
    assert one(spark, tx.headings_match(F.col("a"), F.col("b")), a=a, b=b) is want


def test_section_relevance_by_long_path(spark):
    hit = tx.section_relevant(F.array(F.col("s")), F.lit("Other"), F.col("p"))
    assert one(spark, hit, s="Säännöllinen työaika", p="A > 33 § Säännöllinen työaika > B") is True
    assert one(spark, hit, s="Työaika", p="A > Työaika > B") is False


def test_code_tokens(spark):
    assert one(spark, tx.code_tokens(F.col("q")), q="fooBar_baz x HTTPServer") == ["foo", "bar", "baz", "httpserver"]


def test_passage_text(spark):
    assert one(spark, tx.passage_text(F.lit("T"), F.lit(""), F.lit("b"))) == "T\n\nb"
    assert one(spark, tx.passage_text(F.lit("T"), F.lit("P"), F.lit("b"))) == "T — P\n\nb"
    assert one(spark, tx.passage_text(F.lit(""), F.lit(""), F.lit("b"))) == "b"


@pytest.mark.parametrize("answer, want", [
    ("Intent: order physical card.", "order_physical_card"), ('"Refund_not"', "Refund_not"),
    ("reverted_card_payment", "reverted_card_payment?"), ("Refund_not because", "Refund_not"), ("nothing", None), ("", None),
])
def test_parse_label(spark, answer, want):
    labels = F.array(*map(F.lit, ["order_physical_card", "Refund_not", "reverted_card_payment?"]))
    assert one(spark, tx.parse_label(F.col("q"), labels), q=answer) == want


@pytest.mark.parametrize("token, want", [(" 1 ", "b"), ("2", None), ("-1", None), ("x", None), ("99999999999", None)])
def test_option_label(spark, token, want):
    assert one(spark, tx.option_label(F.col("q"), F.array(F.lit("a"), F.lit("b"))), q=token) == want


def test_yes_mass_and_digit(spark):
    top = F.array(*[F.struct(F.lit(t).alias("token"), F.log(F.lit(p)).alias("logprob")) for t, p in [("yes", 0.6), (" Yes", 0.1), ("no", 0.3)]])
    assert one(spark, tx.yes_probability(top, F.lit(""))) == pytest.approx(0.7)
    none = F.array(F.struct(F.lit("maybe").alias("token"), F.lit(-1.0).alias("logprob")))
    assert one(spark, tx.yes_probability(none, F.lit("Yes!"))) == 1.0
    assert one(spark, tx.first_digit(F.lit("level 2 or 3"))) == 2
    assert one(spark, tx.first_digit(F.lit("none"))) == -1


def test_small_helpers(spark):
    assert one(spark, tx.strip_title(F.lit("AB12_Sample.md"))) == "Sample"
    assert one(spark, tx.forward_slashes(F.lit("a\\b"))) == "a/b"
    assert one(spark, tx.title_or_id(F.lit("  "), F.lit(7))) == "7"
    assert one(spark, tx.truncate_chars(F.lit("abcdef"), 3)) == "abc"


@pytest.mark.parametrize("word, want", [("edeltäjien", "edeltäj"), ("edeltävien", "edeltäv"), ("innostumista", "innostum"), ("taloissa", "talo")])
def test_stem(word, want):
    assert stem(word) == want
