"""Text columns: normal forms, hashes, splits, script and language rules, parsing of lines and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and word lists that results depend on.
HAN, KANA, HANGUL = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", r"\x{3040}-\x{30FF}", r"\x{AC00}-\x{D7AF}"
SCRIPTS = {"cjk": r"[\x{4E00}-\x{9FFF}]", "hangul": r"[\x{AC00}-\x{D7AF}]", "kana": r"[\x{3040}-\x{30FF}]", "cyrillic": r"[\x{0400}-\x{04FF}]", "latin": r"[a-zA-Z]", "thai": r"[\x{0E00}-\x{0E7F}]", "arabic": r"[\x{0600}-\x{06FF}]"}
WER_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
CANTONESE = "[嘅咗唔喺係冇佢啲嚟咁嘢乜噉睇揾俾哋嗰]"
VERSION_TAG = r"(?iu)[\(（\[【](live|演唱会|现场|remaster(ed)?|版|demo|acoustic|instrumental|伴奏|纯音乐|karaoke|翻唱|cover|dj|remix|sped up|slowed)[^\)）\]】]*[\)）\]】]"
TITLE_MARKS = r"(?U)[\s\-_·.,'\"!?，。！？、:：;；/\\()（）\[\]【】]+"
VOWELS = "[aeiouyàâäéèêëîïôöùûüÿ]+"
SPACE = r"(?U)\s+"


def falsy(x: Column, default: str = "") -> Column:
    """default for null and for the empty text."""
    return F.when(x.isNull() | (x == ""), F.lit(default)).otherwise(x)


def strip(x: Column) -> Column:
    """Without blanks (any Unicode space) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, SPACE, " "))


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def norm_title(x: Column) -> Column:
    """Lower case, version tags in brackets and punctuation gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(falsy(x)), VERSION_TAG, ""), TITLE_MARKS, "")


def norm_letters(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)[\W_]+", "")


def norm_stanza(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)\W+", ""))


def norm_wer(x: Column) -> Column:
    """Words for an error rate: bracketed parts gone, a-z 0-9 ' kept, every CJK character a word."""
    x = F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", " "), r"[(（][^)）]*[)）]", " ")
    x = F.regexp_replace(F.lower(x), f"[^a-z0-9' {WER_CJK}]+", " ")
    return collapse(F.regexp_replace(x, f"([{WER_CJK}])", " $1 "))


def norm_words(x: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[\p{L}\p{N}']+"), F.lit(0))


def collapsed_hash(x: Column) -> Column:
    """md5 of the text in lower case with blanks collapsed."""
    return F.md5(F.encode(collapse(F.lower(x)), "UTF-8"))


def stripped_hash(x: Column) -> Column:
    """md5 of the stripped text in lower case; blanks within count."""
    return F.md5(F.encode(F.lower(strip(x)), "UTF-8"))


def hex8(x: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(x, "UTF-8")), 1, 8), 16, 10).cast("long")


def bucket_closed(x: Column) -> Column:
    """[0, 1]: the first 32 bits of md5 over 2^32 - 1."""
    return hex8(x) / F.lit(4294967295.0)


def bucket_open(x: Column) -> Column:
    """[0, 1): over 2^32."""
    return hex8(x) / F.lit(4294967296.0)


def md5_mod(x: Column, n: int) -> Column:
    """The whole 128-bit md5 modulo n, digit by digit."""
    digits = F.split(F.md5(F.encode(x, "UTF-8")), "")
    value = lambda c: F.conv(c, 16, 10).cast("long")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: (s * 16 + value(c)) % n)


def split_of(x: Column, forced_dev: Column | None = None) -> Column:
    """test, dev or train by md5 mod 1000: below 5, below 10, the rest."""
    m = md5_mod(x, 1000)
    out = F.when(m < 5, "test").when(m < 10, "dev").otherwise("train")
    return out if forced_dev is None else F.when(forced_dev & (out == "train"), "dev").otherwise(out)


def script_of(x: Column) -> Column:
    cjk, cyr, lat = count_of(x, r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"), count_of(x, r"[\x{0400}-\x{04FF}]"), count_of(x, "[A-Za-z]")
    total = cjk + cyr + lat
    return F.when(total == 0, "none").when(cjk / total > 0.3, "cjk").when(cyr / total > 0.3, "cyrillic").otherwise("latin")


def script_majority(x: Column) -> Column:
    """The script with most characters of seven; the one seen first wins a tie; none for no text, other for no such character."""
    found = F.array(*[F.struct((-count_of(x, p)).alias("n"), F.regexp_instr(x, F.lit(p)).alias("at"), F.lit(k).alias("script")) for k, p in SCRIPTS.items()])
    best = F.array_min(F.filter(found, lambda s: s["n"] < 0))
    return F.when(falsy(x) == "", "none").otherwise(F.coalesce(best["script"], F.lit("other")))


def caption_language(x: Column) -> Column:
    """Kana and Hangul over 20 characters name a language; else Han against a quarter of the Latin letters, three to one."""
    ja, ko, zh, en = count_of(x, f"[{KANA}]"), count_of(x, f"[{HANGUL}]"), count_of(x, r"[\x{4E00}-\x{9FFF}]"), count_of(x, "[A-Za-z]") / 4
    return F.when(ja > 20, "japanese").when(ko > 20, "korean").when(zh + en == 0, "").when(zh > 3 * en, "mandarin").when(en > 3 * zh, "english").otherwise("mandarin, english")


def iso_language(x: Column, otherwise: Column | None = None) -> Column:
    """kor, jpn, yue or cmn by shares of letters; else what another model says (default und); empty for no letter."""
    han, kana, hang = count_of(x, f"[{HAN}]"), count_of(x, f"[{KANA}]"), count_of(x, f"[{HANGUL}]")
    letters = count_of(x, r"[\p{L}]")
    cantonese = count_of(x, CANTONESE) >= F.greatest(F.lit(2.0), 0.01 * han)
    return (
        F.when(letters == 0, "").when(hang > 0.3 * letters, "kor").when((kana > 0.05 * (han + kana)) & (kana + han > 0.3 * letters), "jpn")
        .when(han > 0.3 * letters, F.when(cantonese, "yue").otherwise("cmn")).otherwise(otherwise if otherwise is not None else F.lit("und"))
    )


def has_only_han(x: Column) -> Column:
    return x.rlike(f"[{HAN}]") & ~x.rlike(f"[{KANA}{HANGUL}a-zA-Z]")


def all_below(x: Column, code_point: str = "24F") -> Column:
    """No code point above."""
    return ~x.rlike(rf"[^\x{{0}}-\x{{{code_point}}}]")


def sung_units(x: Column) -> Column:
    """CJK, kana and Hangul characters, and for each Latin word its vowel groups, one at least."""
    words = F.regexp_extract_all(x, F.lit("[A-Za-zÀ-ÿ']+"), F.lit(0))
    return count_of(x, f"[{HAN}{KANA}{HANGUL}]") + F.aggregate(words, F.lit(0), lambda s, w: s + F.greatest(F.lit(1), F.regexp_count(F.lower(w), F.lit(VOWELS))))


def is_instrumental(x: Column, least: int = 20) -> Column:
    """Fewer than `least` characters once [...] is gone."""
    return F.length(strip(F.regexp_replace(x, r"\[[^\]]*\]", ""))) < least


def prompt_text(caption: Column, lyrics: Column) -> Column:
    return F.concat(F.lit("[Genre] "), strip(caption), F.lit("\n[Lyrics]\n"), strip(lyrics), F.lit("\n"))


def tags(x: Column, pattern: str = "[,;/]+") -> Column:
    return F.filter(F.transform(F.split(x, pattern), lambda t: strip(t)), lambda t: t != "")


def first_artist(x: Column) -> Column:
    return F.lower(strip(F.get(F.split(falsy(x), "[,/&、，]"), F.lit(0))))


def markers(x: Column) -> Column:
    """What stands in [...]."""
    return F.regexp_extract_all(x, F.lit(r"\[([^\]]*)\]"), F.lit(1))


def timestamp(seconds: Column) -> Column:
    """[mm:ss.s], the tenth rounded to even."""
    tenths = F.bround(seconds * 10).cast("long")
    return F.format_string("[%02d:%02d.%d]", (tenths / 600).cast("long"), (tenths % 600 / 10).cast("long"), tenths % 10)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_id(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def without_db(x: Column) -> Column:
    """Directives without numbers in dB."""
    return collapse(F.regexp_replace(x, r"(?i)[+\-−]?\d+(\.\d+)?\s*dB", ""))


def chat_prompt(fields: list[tuple[str, Column]]) -> Column:
    """User: name: value lines of the fields that are there, then the assistant's opening."""
    return F.concat(F.lit("User: "), F.concat_ws("\n", *[F.when(falsy(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields]), F.lit("\n\nAssistant: <think></think>"))


def keep_tail(ids: Column, budget: int, head: int = 0) -> Column:
    """At most budget ids: the first `head` ones and the end."""
    return F.when(F.size(ids) <= budget, ids).otherwise(F.concat(F.slice(ids, 1, head), F.slice(ids, F.size(ids) - (budget - head) + 1, budget - head)))


def letters_encoded(x: Column, alphabet: str = " abcdefghijklmnopqrstuvwxyz") -> Column:
    """Positions in the alphabet; other characters are left out."""
    at = F.create_map(*[F.lit(v) for k, c in enumerate(alphabet) for v in (c, k)])
    return F.filter(F.transform(F.split(F.lower(x), ""), lambda c: at[c]), lambda i: i.isNotNull())


# How a song is asked for by language; the assistant's opening.
REQUESTS = {"eng": "Make a song.", "cmn": "做一首歌。", "yue": "整一首歌。", "jpn": "曲を作って。", "kor": "노래를 만들어 줘.", "spa": "Haz una canción.", "fra": "Fais une chanson.", "deu": "Mach ein Lied.", "ita": "Fai una canzone.", "por": "Faça uma música.", "rus": "Сделай песню."}
THINK = "Assistant: <think></think>"


def request_text(lang: Column, known: dict[str, str] = REQUESTS) -> Column:
    """The request in the song's language, in English where there is none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), F.coalesce(lang, F.lit("eng"))), F.lit(known["eng"]))


def one_line(x: Column, most: int | None = None) -> Column:
    """Blanks collapsed; no more than so many characters."""
    out = collapse(falsy(x))
    return out if most is None else F.substring(out, 1, most)


def fitting(rows: Column, before: Column, most: int) -> Column:
    """How many of an array's rows fit: each takes its length and a line end behind `before` characters, and the first that passes `most` ends it."""
    step = lambda s, r: F.when(s["open"] & (s["n"] + F.length(r) <= most), F.struct((s["n"] + F.length(r) + 1).alias("n"), (s["k"] + 1).alias("k"), F.lit(True).alias("open"))).otherwise(F.struct(s["n"].alias("n"), s["k"].alias("k"), F.lit(False).alias("open")))
    kind = "struct<n:int,k:int,open:boolean>"
    start = F.struct(before.cast("int").alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open")).cast(kind)
    return F.aggregate(rows, start, lambda s, r: step(s, r).cast(kind))["k"]


def song_prompt(request: Column, fields: dict[str, Column], live: Column, seconds: Column, lines: Column, times: bool = True, most: int = 6000) -> Column:
    """The prompt of a song: the request, the fields that are there, is_live and dur, then as many lines (structs of t0 and text) as fit."""
    row = lambda s: F.concat(timestamp(s["t0"]), F.lit(" "), one_line(s["text"])) if times else one_line(s["text"])
    named = [F.when(one_line(v) != "", F.concat(F.lit(f"{k}: "), one_line(v))) for k, v in fields.items()]
    dur = F.when(F.coalesce(seconds, F.lit(0.0)) != 0, F.concat(F.lit("dur: "), F.format_string("%.1f", F.bround(seconds, 1))))
    head = F.array_compact(F.array(F.concat(F.lit("User: "), one_line(request)), *named, F.when(live.isNotNull(), F.concat(F.lit("is_live: "), live.cast("string"))), dur))
    rows = F.transform(F.coalesce(lines, F.array().cast("array<struct<t0:double,text:string>>")), row)
    used = F.length(F.array_join(head, "\n")) + 1 + len("lines:") + 1
    kept = F.when(F.size(rows) > 0, F.concat(F.array(F.lit("lines:")), F.slice(rows, 1, fitting(rows, used, most)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(head, kept), "\n"), F.lit(f"\n\n{THINK}"))


def lyric_targets(ids: Column, opening: int = 92, closing: int = 94, newline: int = 11) -> Column:
    """The tokens of a line's words: without a leading marker, and without newlines."""
    at = F.array_position(ids, closing).cast("int")
    body = F.when((F.get(ids, F.lit(0)) == opening) & (at > 0), F.slice(ids, at + 1, F.size(ids))).otherwise(ids)
    return F.filter(body, lambda t: t != newline)


def directive_at(sections: Column, at: Column, shift: float = 0.5) -> Column:
    """The directive of the first section (start, end, directive) that holds at + shift and has one; else the empty text."""
    hit = F.filter(sections, lambda s: (s["start"] <= at + shift) & (at + shift < s["end"]) & (falsy(s["directive"]) != ""))
    return F.coalesce(F.get(hit, F.lit(0))["directive"], F.lit(""))


def directive_of(directives: Column, index: Column) -> Column:
    """The entry of a map by section number; the empty text where it has none."""
    return F.coalesce(F.try_element_at(directives, index), F.lit(""))
