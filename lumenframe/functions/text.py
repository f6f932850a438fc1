"""String, path and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalogue's rules.
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv")
SCANNED_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "mp4", "avi", "mov")
TRASH_FOLDERS = ("$RECYCLE.BIN", ".TRASH", "TRASH", ".TRASH-1000", "TRASH-1000")
WORK_FOLDERS = (".git", "__pycache__")
JAPAN_NAMES = ("JP", "Japan", "日本")


def normalize_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, no ``.`` parts or trailing slash, case folded; empty stays empty."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(?<=.)/$", "")
    return F.lower(p)


def escape_like(text: Column) -> Column:
    """Escape LIKE's wildcards with ``|``."""
    return F.replace(F.replace(F.replace(text, F.lit("|"), F.lit("||")), F.lit("_"), F.lit("|_")), F.lit("%"), F.lit("|%"))


def under_folder(path_key: Column, folder: str) -> Column:
    """Paths below ``folder``; on the raw key column, so that the prefix reaches the scan."""
    return F.startswith(path_key, F.lit(folder.replace("\\", "/").rstrip("/").lower() + "/"))


def is_video(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(VIDEO_EXTENSIONS)})$")


def in_trash_by_path(path: Column) -> Column:
    return F.upper(path).rlike(r"TRASH|\$RECYCLE\.BIN")


def year_text(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def date_header(date: Column) -> Column:
    """The day of a capture date, or a placeholder."""
    return F.when(F.coalesce(date, F.lit("")) == "", F.lit("Unknown Date")).otherwise(F.replace(F.substring_index(date, " ", 1), F.lit("-"), F.lit("/")))


def location_label(country: Column, prefecture: Column, city: Column) -> Column:
    """``prefecture, city`` at home, ``country, city`` elsewhere, what there is otherwise."""
    c, p, t = (F.nullif(x, F.lit("")) for x in (country, prefecture, city))
    home = c.isin(*JAPAN_NAMES)
    first = F.when(F.coalesce(home, F.lit(False)), p).otherwise(c)
    return F.coalesce(F.nullif(F.concat_ws(", ", first, t), F.lit("")), F.lit("Unknown Location"))


def size_text(size: Column) -> Column:
    """One decimal, halves to even as C prints them; Java's formats would round them up. Null stays null."""
    mb = 1024.0 * 1024.0
    one = lambda unit, name: F.format_string(f"%.1f {name}", F.rint(size * 10 / unit) / 10)
    return F.when(size > mb, one(mb, "MB")).when(size.isNotNull(), one(1024.0, "KB"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^./]+$", "")


def thumbnail_key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def restore_path(path: Column) -> Column:
    """Where a file in a trash folder goes back to: beside the trash folder, below ``restore``."""
    return F.regexp_replace(path, r"^(.*)/[^/]*(?i:trash)[^/]*/(?:.*/)?([^/]+)$", "$1/restore/$2")


def person_name(name: Column, cluster: Column, offset: int = 0) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Person "), (cluster + offset).cast("string")))


def parse_tags(tags: Column) -> Column:
    """``id:name,...`` as structs sorted by label; nameless ones get a label."""
    parts = F.filter(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: x != "")

    def one(x: Column) -> Column:
        number, name = F.substring_index(x, ":", 1), F.regexp_extract(x, r"^[^:]*:(.*)$", 1)
        label = F.when(name != "", name).when(number == "-1", F.lit("Unknown")).otherwise(F.concat(F.lit("Person "), number))
        return F.struct(label.alias("label"), number.alias("id"))

    return F.array_sort(F.transform(parts, one))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def pct_coerce(text: Column, default: float) -> Column:
    """A fraction from a setting that older versions stored as a percentage."""
    value = text.try_cast("double")
    return F.coalesce(F.when((value > 1) & F.lit(default <= 1), value / 100).otherwise(value), F.lit(default))


def month_text(date: Column) -> Column:
    return F.substring(date, 6, 2).try_cast("int")
