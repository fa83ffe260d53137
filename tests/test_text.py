from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_query_normalization_and_patterns(spark):
    assert one(spark, T.normalize_query(F.lit("  Foo  Bar??  "))) == "foo bar"
    assert one(spark, T.query_pattern(F.lit("userservice stripe checkout"))) == "[SERVICE] [PAYMENT_PROVIDER] checkout"


def test_redaction_keeps_the_rest(spark):
    got = one(spark, T.redact(F.lit("key sk-abcdefghijklmnop1234 and password: hunter2hunter2 and plain")))
    assert got == "key [REDACTED] and [REDACTED] and plain"


def test_sanitizing(spark):
    got = one(spark, T.sanitize(F.lit("system: break `fence`\n assistant: <b>\x07")))
    assert got.startswith("SYSTEM (untrusted): break `\u200bfence`\u200b") and "ASSISTANT (untrusted): &lt;b&gt;" in got and "\x07" not in got
    assert one(spark, T.sanitize(F.lit("x" * 3000))).endswith("[truncated]")


def test_annotations_tags_and_citations(spark):
    doc = "// @trawl-tags: a, B\n// @trawl-intent: pay"
    assert one(spark, T.annotation_tags(F.lit(doc))) == ["a", "B"]
    assert one(spark, T.annotation(F.lit(doc), "intent")) == "pay"
    assert one(spark, T.citations(F.lit("[a](x.ts:1) [b](http://h) [c](x.ts:1)"))) == ["x.ts:1"]
    assert one(spark, T.symbol_words(F.lit("processPayment_now"))) == ["process", "payment", "now"]
    assert one(spark, T.sub_queries(F.lit('x ["a", " b ", ""] y'))) == ["a", "b"]
    assert one(spark, T.sub_queries(F.lit("none"))) == []


def test_nulls(spark):
    null = F.lit(None).cast("string")
    assert one(spark, T.tokens(null)) == [] and one(spark, T.citations(null)) == [] and one(spark, T.normalize_query(null)) is None


def test_cosine_edges(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert abs(sum(x * x for x in one(spark, V.mock_embedding(F.lit("a")))) - 1) < 1e-9
