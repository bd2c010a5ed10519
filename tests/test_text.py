import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text

TRUE = ["mundo.", "mundo!", "¿qué?", "世界。", 'mundo."', "3.", "Анна.", "хорошо.", "готов?", "..."]
FALSE = ["mundo", "Dr.", "etc.", "J.", "г.", "гг.", "т.д.", "т.е.", "ул.", "см.", "млн.", "проф.", "А.", ""]


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(column).collect()]


def test_ends_sentence(spark):
    assert one(spark, TRUE, text.ends_sentence(F.col("t"))) == [True] * len(TRUE)
    assert one(spark, [*FALSE, None], text.ends_sentence(F.col("t"))) == [False] * (len(FALSE) + 1)


def test_no_break_space_is_white_space(spark):
    assert one(spark, ["a.\u00a0", "\u00a0x "], text.strip(F.col("t"))) == ["a.", "x"]
    assert one(spark, ["ab.\u00a0"], text.ends_sentence(F.col("t"))) == [True]


def test_clip_key(spark):
    key = text.clip_key(F.col("t"), F.lit("af_heart"), F.lit("en"))
    assert one(spark, ["привет"], key) == ["0aa3a7b0da1369a5"]


def test_invented(spark):
    found = ["Thanks for watching!", "  thank you for watching", "Редактор субтитров А", "[Music]", "♪ ♪", "字幕by x"]
    real = ["I said thanks for watching", "music", "да да да"]
    assert one(spark, found, text.invented(F.col("t"))) == [True, True, True, True, False, True]
    assert one(spark, real, text.invented(F.col("t"))) == [False] * 3


def test_replies(spark):
    replies = ['{"a": 1}', 'Here:\n```json\n{"a": 2}\n```', "none", None]
    got = one(spark, replies, F.try_variant_get(text.reply_object(F.col("t")), "$.a", "int"))
    assert got == [1, 2, None, None]


def test_readable_names_and_lines(spark):
    assert one(spark, ["  x ", " ", "y" * 2001], text.readable(F.col("t"), F.lit("ValueError"))) == ["x", "ValueError", "y" * 2000 + "…"]
    assert one(spark, ["a/b: c"], text.safe_name(F.col("t"))) == ["ab c"]
    assert one(spark, ["en", "xx"], text.language_name(F.col("t"))) == ["English", "xx"]
    assert one(spark, ["large", "me/own"], text.model_id(F.col("t"))) == ["openai/whisper-large", "me/own"]
    assert one(spark, ["a\nb "], text.lyric_line(F.lit(65.25), F.col("t"))) == ["[01:05.25]a b"]
    assert one(spark, ["a"], text.lyric_line(F.lit(59.999), F.col("t"))) == ["[00:60.00]a"]


@pytest.mark.parametrize("speed", [0.1, 0.5, 1.0, 1.7, 2.0, 5.0])
def test_tempo_chain(speed):
    chain = text.tempo_chain(speed)
    assert math.isclose(math.prod(chain), speed) and all(0.5 <= f <= 2.0 for f in chain)
