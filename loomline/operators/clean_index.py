"""The clean index of songs: flags of text, timing and audio, duplicates, splits, weights and what is good for which use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .filters import flags, has_none, tier
from .joins import last_wins, membership, single_link

# Patterns of titles, ranks of kinds and sources, bounds, and the flags that rule a row out.
JUNK = (
    r"(?iU)有声书|有声小说|听力|朗读|讲座|课程|第.{1,3}课|相声|评书|小品|广播剧(?!.{0,6}(主题曲|插曲|片尾|片头曲|曲))|单词|audiobook|\blessons?\b|vocabulary"
    r"|白噪音|白噪声|white noise|pink noise|brown noise|助眠|胎教|冥想引导|guided meditation|asmr|铃声|ringtone|sound effect|音效|闹钟"
)
ACC = r"(?iU)伴奏|karaoke|off ?vocal|instrumental|inst\.|\(inst\)|纯音乐版|backing track|カラオケ|minus one|mr\b"
KINDS = {"timed": 3, "untimed": 2, "instrumental": 1, "none": 0}
SOURCES = {"ne": 5, "kg": 4, "jm": 3, "sd": 2, "yt": 1}
BANDS = [(19000, None), (16000, "band_lt19k")]
LYRIC_BAD = ["bad_audio", "silent", "lyr_few", "lyr_after_end", "lyr_zero", "lyr_fast", "lyr_partial", "acc_lyrics", "acc", "junk", "dup", "short", "long"]
AUDIO_BAD = ["junk", "dup", "bad_audio", "silent"]


def text_flags(timing: Column | None = None) -> Column:
    """Flags from lyric_kind, n_lines, title, album, duration and is_live, those of the lines' timing (an array) among them in their place."""
    timed = F.col("lyric_kind") == "timed"
    junk = F.coalesce(F.col("title"), F.lit("")).rlike(JUNK) | F.coalesce(F.col("album"), F.lit("")).rlike(JUNK)
    acc = F.coalesce(F.col("title"), F.lit("")).rlike(ACC)
    few = flags({"lyr_few": timed & (F.col("n_lines") < 4)})
    rest = flags({"junk": junk, "short": F.col("duration") < 60, "long": F.col("duration") > 600, "acc": acc, "acc_lyrics": acc & timed, "live": F.col("is_live")})
    return F.concat(few, F.coalesce(timing, F.array().cast("array<string>")), rest) if timing is not None else F.concat(few, rest)


def scan_flags() -> Column:
    """Flags from a scan's row: __scan (whether there is one), err, cut_hz, clip, lr_corr, silence. Too short a file is no fault."""
    read = F.col("__scan").isNotNull() & F.col("err").isNull()
    band = tier(F.col("cut_hz"), BANDS, "band_lt16k")
    named = {"unscanned": F.col("__scan").isNull(), "bad_audio": F.col("err").isNotNull() & ~F.col("err").startswith("ValueError: short")}
    heard = {"band_lt16k": read & (band == "band_lt16k"), "band_lt19k": read & (band == "band_lt19k"), "clipped": read & (F.col("clip") > 1e-3), "mono": read & (F.col("lr_corr") >= 0.999), "silent": read & (F.col("silence") > 0.5)}
    return flags(named | heard)


def with_scan(songs: DataFrame, scans: DataFrame) -> DataFrame:
    """songs with the flags and cut_hz of their file's last scan; scans(audio_path, at, err, cut_hz, clip, lr_corr, silence)."""
    one = last_wins(scans, "audio_path", "at").drop("at").withColumn("__scan", F.lit(1))
    x = songs.join(one, "audio_path", "left")
    return x.withColumn("flags", F.concat("flags", scan_flags())).withColumn("cut_hz", F.when(F.col("err").isNull(), F.col("cut_hz"))).drop("__scan", "err", "clip", "lr_corr", "silence")


def ranked(col: str, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv]), F.col(col)), F.lit(0))


def with_duplicates(songs: DataFrame, gap: float = 2.0) -> DataFrame:
    """dup_of, and the flag dup: rows of one title, first artist and kind of performance whose durations follow within gap; the best one stays.

    Best is: kind of lyrics, no junk, lossless, 48 kHz, source, number of lines; then the shorter, then the smaller id.
    """
    x = single_link(songs, ["nt", "artist", "is_live"], "duration", "id", gap)
    lossless = F.lower("audio_path").rlike(r"\.(flac|wav)$")
    best = [ranked("lyric_kind", KINDS), has_none("flags", ["junk"]), lossless, F.coalesce(F.col("sr"), F.lit(0)) >= 48000, ranked("source", SOURCES), F.col("n_lines")]
    w = Window.partitionBy("nt", "artist", "is_live", "cluster").orderBy(*[b.desc() for b in best], "duration", "id")
    x = x.withColumn("__best", F.first("id").over(w)).withColumn("dup_of", F.when(F.col("__best") != F.col("id"), F.col("__best")))
    return x.withColumn("flags", F.when(F.col("dup_of").isNotNull(), F.concat("flags", F.array(F.lit("dup")))).otherwise(F.col("flags"))).drop("__best", "cluster")


def with_splits(songs: DataFrame, held: DataFrame, earlier: DataFrame) -> DataFrame:
    """split by the title's hash, dev for every title of which a row is held out by path; in_v5: whether the path was in an earlier training set."""
    forced = songs.join(held.select("audio_path").distinct(), "audio_path", "left_semi").select("nt")
    x = membership(membership(songs, forced, "nt", "__held"), earlier, "audio_path", "in_v5")
    h = T.hex8(F.col("nt")) % 1000
    return x.withColumn("split", F.when(F.col("__held") | h.between(5, 9), "dev").when(h < 5, "test").otherwise("train")).drop("__held")


def with_weights(songs: DataFrame, artist: int = 300, album: int = 100) -> DataFrame:
    """w: 1, or less where an artist or album has more rows than its bound; duplicates are not counted, and have the weight of the others."""
    kept = songs.where(has_none("flags", ["dup"]))
    shelf = F.lower(T.strip(F.coalesce(F.col("album"), F.lit(""))))
    count = lambda x, by, n: x.groupBy(by).agg(F.count("*").alias(n)).where(F.col(by) != "")
    x = songs.withColumn("__album", shelf).join(count(kept, "artist", "__na"), "artist", "left").join(count(kept.withColumn("__album", shelf), "__album", "__nb"), "__album", "left")
    return x.withColumn("w", F.round(F.least(F.lit(1.0), artist / F.col("__na"), album / F.col("__nb")), 4)).drop("__na", "__nb", "__album")


def titled(songs: DataFrame) -> DataFrame:
    """songs with nt, the normalised title (the id where that is empty), and artist, the first one."""
    title = T.norm_title(F.coalesce(F.col("title"), F.lit("")))
    return songs.withColumn("nt", F.when(title == "", F.col("id").cast("string")).otherwise(title)).withColumn("artist", T.first_artist(F.coalesce(F.col("artists"), F.lit(""))))


def with_uses(songs: DataFrame) -> DataFrame:
    """lyric_ok: timed and without a flag against lyrics; audio_ok: without a flag against audio, 30 to 900 seconds."""
    x = songs.withColumn("lyric_ok", (F.col("lyric_kind") == "timed") & has_none("flags", LYRIC_BAD))
    return x.withColumn("audio_ok", has_none("flags", AUDIO_BAD) & F.col("duration").between(30, 900))


def clean_index(songs: DataFrame, scans: DataFrame, held: DataFrame, earlier: DataFrame, timing: Column | None = None) -> DataFrame:
    """songs(id, source, audio_path, title, artists, album, duration, sr, lyric_kind, is_live, n_lines) with flags, cut_hz, dup_of, split, in_v5, w, lyric_ok and audio_ok."""
    x = with_scan(titled(songs).withColumn("flags", text_flags(timing)), scans)
    return with_uses(with_weights(with_splits(with_duplicates(x), held, earlier))).drop("nt", "artist")
