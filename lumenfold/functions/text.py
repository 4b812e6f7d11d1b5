"""Column functions on paths, captions and transcript cues. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters trimmed off a cue before it is compared.
CUE_EDGE = " \t.,!?…\"'«»“”‘’()[]"
#: Characters trimmed off a word before runs of it are counted.
WORD_EDGE = ".,!?…\"'«»“”‘’()[]:;"
#: Cue texts that speech models invent over silence, on the normal form.
INVENTED_CUES = (
    r"продолжение следует",
    r"dimatorzok|торжок",
    r"^(субтитры|добавил субтитры)\b.*",
    r"^субтитры (сделал|создал|создавал|делал|подогнал|подготовил)\b.*",
    r"^редактор субтитров\b.*",
    r"^корректор\b.*",
    r"^спасибо за просмотр$",
    r"^спасибо за субтитры\b.*",
    r"^подпишись на канал$",
    r"^подписывайтесь на канал$",
    r"^аплодисменты$",
    r"^динамичная музыка$",
    r"^спокойная музыка$",
    r"^превед,? медвед$",
    r"^thanks? for watching$",
    r"^thank you for watching$",
    r"^subtitles by\b.*",
    r"^subtitles by the amara\.org community$",
    r"^transcribed by\b.*",
    r"^please subscribe\b.*",
    r"^like and subscribe\b.*",
    r"^i'?ll see you next time$",
    r"^applause$",
    r"^music$",
    r"^[♩-♯\s]+$",
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def normalized_stem(path: Column) -> Column:
    """Lower-case stem without an edit suffix, a copy number and outer separators."""
    stem = F.regexp_replace(F.lower(file_stem(path)), r"-(edited|effects)$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"\(\d+\)$", ""), r"^[ ._-]+|[ ._-]+$", "")


def trim_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def normal_cue(text: Column) -> Column:
    """Cue text with spacing collapsed, outer punctuation dropped, lower case."""
    return F.lower(trim_chars(F.regexp_replace(text, r"(?U)\s+", " "), CUE_EDGE))


def is_invented_cue(text: Column) -> Column:
    """True if the cue is a known invention of speech models; blank text is one, null is not."""
    normal = normal_cue(text)
    return F.coalesce((normal == "") | normal.rlike("(?U)" + "|".join(f"(?:{p})" for p in INVENTED_CUES)), F.lit(False))


def excerpt(text: Column, most: int = 500) -> Column:
    """At most ``most`` characters, cut at a word and ended with an ellipsis if cut."""
    tidy = F.btrim(text)
    cut = F.regexp_replace(F.left(tidy, F.lit(most)), r" [^ ]*$", "")
    return F.when(F.length(tidy) <= most, tidy).otherwise(F.concat(F.rtrim(cut, F.lit(" .,;:!?")), F.lit("…")))


def cue_plaintext(srt: Column) -> Column:
    """The spoken lines of subtitles: no numbers, timings or blank lines, joined by a blank."""
    lines = F.filter(
        F.transform(F.split(srt, r"\r?\n"), lambda line: F.btrim(line)),
        lambda line: (line != "") & ~line.contains("-->") & ~line.rlike(r"^\d+$"),
    )
    return F.array_join(lines, " ")


def format_cue_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with the milliseconds rounded and carried; negative times count as 0."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000),
        F.floor(ms / 60000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def human_bytes(size: Column) -> Column:
    """Size with one decimal in the largest unit below 1024, B without decimals."""
    out = F.format_string("%d B", size.cast("bigint"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(
            size >= 1024**power, F.format_string(f"%.1f {unit}", F.round(size / 1024**power, 1))
        ).otherwise(out)
    return out


def collapse_word_runs(text: Column, least: int = 5) -> Column:
    """Runs of ``least`` or more equal words in a cue become their first word.

    Words compare without outer punctuation and letter case. A text without such a
    run is returned unchanged, spacing included; a changed one loses its trailing
    blanks and commas.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    def bare(word: Column) -> Column:
        return F.lower(trim_chars(word, WORD_EDGE))

    start = F.struct(
        F.array().cast("array<array<string>>").alias("runs"), F.lit(None).cast("string").alias("last")
    )

    def step(state: Column, word: Column) -> Column:
        normal = bare(word)
        same = (normal != "") & normal.eqNullSafe(state["last"])
        grown = F.when(
            same,
            F.concat(
                F.slice(state["runs"], F.lit(1), F.greatest(F.size(state["runs"]) - 1, F.lit(0))),
                F.array(F.concat(F.element_at(state["runs"], -1), F.array(word))),
            ),
        ).otherwise(F.concat(state["runs"], F.array(F.array(word))))
        return F.struct(grown.alias("runs"), normal.alias("last"))

    runs = F.aggregate(words, start, step, lambda state: state["runs"])
    long = F.exists(runs, lambda run: F.size(run) >= least)
    kept = F.flatten(F.transform(runs, lambda run: F.when(F.size(run) >= least, F.slice(run, 1, 1)).otherwise(run)))
    return F.when(long, F.rtrim(F.array_join(kept, " "), F.lit(" ,"))).otherwise(text)


def join_make_model(make: Column, model: Column) -> Column:
    """Make and model without naming the brand twice; null if both are blank."""
    mk, md = F.nullif(F.btrim(make), F.lit("")), F.nullif(F.btrim(model), F.lit(""))
    return F.when(F.lower(md).startswith(F.lower(mk)), md).otherwise(
        F.nullif(F.concat_ws(" ", mk, md), F.lit(""))
    )


def marker_key(description: Column, marker: str) -> Column:
    """The key after ``marker`` at the start of a line; null if absent or blank."""
    found = F.regexp_extract(description, r"(?m)^\s*" + marker + r"([^\n]*)$", 1)
    return F.nullif(F.btrim(found), F.lit(""))


def notes_body(text: Column, hint: str) -> Column:
    """The text below the front matter, without a leading heading and without hint paragraphs.

    A hint is a paragraph in underscores that holds ``hint``; paragraphs are set apart by
    one blank line.
    """
    body = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")
    bare = F.regexp_replace(F.regexp_replace(body, r"\A\s*\n", ""), r"\A# [^\n]*(?:\n|\z)", "")
    paragraphs = F.filter(F.split(bare, r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: F.btrim(p, F.lit(" \t\n")) != "")
    tidy = F.transform(paragraphs, lambda p: F.btrim(p, F.lit("\n")))
    kept = F.filter(tidy, lambda p: ~(F.btrim(p).startswith("_") & F.btrim(p).endswith("_") & p.contains(hint)))
    return F.btrim(F.array_join(kept, "\n\n"), F.lit(" \t\n"))


def rewrite_paths(text: Column, renamed: dict[str, str]) -> Column:
    """``text`` (plain or JSON) with whole path parts renamed, one name after another."""
    for old, new in renamed.items():
        part = "/" + "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in old)
        text = F.regexp_replace(text, part + r"(?=[/\n\"']|$)", "/" + new.replace("\\", "\\\\").replace("$", "\\$"))
    return text
