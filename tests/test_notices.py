"""Gates of the line cleaner: rules that are tried only on lines which may have them find what they found before."""

import random

from pyspark.sql import functions as F

from loomline.functions import cleaning as C

PIECES = ["版权", "版权所有", "著作权", "商用", "beat", "用这个beat", "AI 训练", "Kaker", "maÅer tool", "MAKER TOOL", "©", "℗", "https://", "HTTP://", "www.", "a.b-@c.d", "@c.d", "-@x-y.é", "é@x.y", "-.com", "a-.com", "é.CN", ".net", "x.orgs", "x.org", "LRC by", "lrcby", "lrcb", "lrc焕", "lrcx", "LRC  by", "翻唱", "音乐人", "平台", "音乐平台", "企划：", "a", " ", "(", "）", "歌", "　", ".", "ſs", "：", "x:", "[", "】", "/", "|"]


def test_notices_equal_the_whole_pattern(spark):
    rng = random.Random(6)
    lines = PIECES + ["".join(rng.choices(PIECES, k=rng.randint(2, 6))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    found = df.select(C.is_notice(F.col("t")).alias("a"), F.col("t").rlike(C.NOTICE).alias("b"), "t").collect()
    assert [r.t for r in found if r.a != r.b] == [] and 500 < sum(r.a for r in found) < 6000


def test_ends_that_may_trail(spark):
    rng = random.Random(7)
    signs = ["歌", "a", "が", " ", "。", "，", "　", "\r", " ", "\u0085", "!", "词" * 6]
    df = spark.createDataFrame([("".join(rng.choices(signs, k=rng.randint(1, 9))),) for _ in range(6000)], "t string")
    has = F.col("t").rlike(C.TRAIL_SPACED) | F.col("t").rlike(C.TRAIL_GLUED)
    assert df.where(has & ~C._may_trail(F.col("t"))).count() == 0 and df.where(has).count() > 500
