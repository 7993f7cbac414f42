"""Listings and logs given as text: FTP lines, commits, keyed playlists, delimiters (S-21, S-24, S-46, S-48, S-56, W-03). JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def unix_list_line(line: Column, today: Column) -> Column:
    """A Unix listing's line as (mode, size, name, target, day); a stamp without a year is the latest one not after tomorrow."""
    pattern = r"^([-dl][-rwxsStT]{9})\S*\s+\d+\s+\S+\s+\S+\s+(\d+)\s+(\w{3})\s+(\d{1,2})\s+(\d{4}|\d{1,2}:\d{2})\s(.+)$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    month = ((F.instr(F.lit(MONTHS), part(3)) + 2) / 3).cast("int")
    day = part(4).cast("int")
    year = F.year(today)
    this = F.make_date(year, month, day)
    guess = F.when(this > F.date_add(today, 1), F.make_date(year - 1, month, day)).otherwise(this)
    dated = F.when(part(5).contains(":"), guess).otherwise(F.make_date(F.try_to_number(F.substring_index(part(5), ":", 1), F.lit("9999")).cast("int"), month, day))
    name = F.when(part(1).startswith("l"), F.substring_index(part(6), " -> ", 1)).otherwise(part(6))
    target = F.when(part(1).startswith("l"), F.nullif(F.regexp_extract(part(6), " -> (.*)$", 1), F.lit("")))
    return F.when(line.rlike(pattern), F.struct(part(1).alias("mode"), part(2).cast("long").alias("size"), name.alias("name"), target.alias("target"), dated.alias("day")))


def mlsd_line(line: Column) -> Column:
    """A machine listing's line as (kind, size, name)."""
    fact = lambda k: F.regexp_extract(F.lower(F.substring_index(line, " ", 1)), rf"(?:^|;){k}=([^;]*)", 1)
    return F.struct(fact("type").alias("kind"), F.nullif(fact("size"), F.lit("")).cast("long").alias("size"), F.regexp_extract(line, "^[^ ]* (.*)$", 1).alias("name"))


def commits(log: DataFrame, text: str = "text") -> DataFrame:
    """Commits of a log whose records end in a record separator and whose fields are parted by unit separators."""
    rows = log.select(F.explode(F.split(text, "\u001e")).alias("r")).where(~F.col("r").rlike(r"^\s*$")).select(F.split(F.regexp_replace("r", "^\\s+", ""), "\u001f").alias("f"))
    at = lambda k: F.try_element_at("f", F.lit(k + 1))
    return rows.select(at(0).alias("hash"), F.substring(at(0), 1, 7).alias("short"), at(1).alias("author"), F.timestamp_seconds(at(2).cast("long")).cast("timestamp_ntz").alias("when"), F.filter(F.split(at(3), " "), lambda p: p != "").alias("parents"), at(4).alias("subject"))


def keyed_playlist(lists: DataFrame, text: str = "text") -> DataFrame:
    """Tracks of a keyed playlist (``File1=``, ``Title1=``, ``Length1=``), renumbered without gaps; entries without a file are left out."""
    lines = lists.select(F.explode(F.split(text, "\r?\n")).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(?i)(File|Title|Length)(\d+)\s*=\s*(.*)$", k)
    rows = lines.select(F.lower(part(1)).alias("what"), part(2).alias("n"), part(3).alias("v")).where("what <> ''").select("what", F.col("n").cast("int").alias("n"), "v")
    wide = rows.groupBy("n").pivot("what", ["file", "title", "length"]).agg(F.first("v")).where("file IS NOT NULL AND file <> ''")
    return wide.select(F.row_number().over(Window.orderBy("n")).alias("ord"), F.coalesce("title", F.lit("")).alias("title"), F.greatest(F.lit(0), F.coalesce(F.col("length").try_cast("int"), F.lit(0))).alias("seconds"), F.col("file").alias("target"))


def delimiter(sample: Column) -> Column:
    """The delimiter that parts the first lines into the most and equal fields: comma, semicolon, tab or bar."""
    lines = F.filter(F.slice(F.split(sample, "\n"), 1, 10), lambda x: x != "")
    fields = lambda sep: F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
    score = lambda sep: F.when(F.array_min(fields(sep)) == F.array_max(fields(sep)), F.array_max(fields(sep)) * 10).otherwise(F.coalesce(F.array_min(fields(sep)), F.lit(0)))
    best = F.array_max(F.array(*[F.struct(score(s).alias("score"), F.lit(-k).alias("order"), F.lit(s).alias("sep")) for k, s in enumerate((",", ";", "\t", "|"))]))
    return best["sep"]


#: Some suffixes and the language that each is coloured as.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rs": "rust", "go": "go", "rb": "ruby", "sh": "shell", "sql": "sql", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown"}


def language(path: Column) -> Column:
    """The language of a path's suffix, null without one."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
