"""Path and file-name functions as native columns. Both kinds of slash part segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(c: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(c, "\\\\", "/"), "/"), lambda x: x != "")


def drop_last(c: Column | str, n: int = 2) -> Column:
    """The path without its last ``n`` segments; '' where nothing is left."""
    s = segments(c)
    return F.array_join(F.slice(s, F.lit(1), F.greatest(F.size(s) - n, F.lit(0))), "/")


def from_end(c: Column | str, n: int) -> Column:
    """The n-th segment from the end, null if there are fewer."""
    return F.try_element_at(segments(c), F.lit(-n))


def base_name(c: Column | str) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column | str) -> Column:
    return F.regexp_replace(c, "\\.[^.]*$", "")


def image_number(c: Column | str) -> Column:
    """Digits after the last dash up to the first dot, else digits after ``image``, else 0."""
    last = F.substring_index(base_name(c), "-", -1)
    dashed = F.when(base_name(c).contains("-"), F.try_to_number(F.regexp_extract(F.substring_index(last, ".", 1), "^([0-9]{1,18})$", 1), F.lit("9" * 18)))
    named = F.regexp_extract(c, "image([0-9]{1,18})", 1).try_cast("long")
    return F.coalesce(dashed.cast("long"), named, F.lit(0)).cast("long")


def safe_name(c: Column | str) -> Column:
    """Letters, digits, spaces, dashes and underscores; spaces at the end go, others become underscores."""
    return F.translate(F.rtrim(F.regexp_replace(c, "[^\\p{L}\\p{N} _-]", "")), " ", "_")


#: fixed values in this module: folder names that tell packages, questions and answers
def after_marker(c: Column | str, marker: str = "试题包") -> tuple[Column, Column]:
    """The segments before a marker segment: the one right before it and the one before that."""
    s = segments(c)
    at = F.array_position(s, marker).cast("int")
    get = lambda k: F.when(at > k, F.try_element_at(s, at - k))
    return get(1), get(2)


def sub_type(c: Column | str, question: tuple[str, ...] = ("题目", "试题"), answer: str = "答案") -> Column:
    """What a file's folder holds: questions, answers, or both."""
    folder = F.coalesce(from_end(c, 2), F.lit(""))
    asks = F.lit(False)
    for q in question:
        asks = asks | folder.contains(q)
    return F.when(asks & ~folder.contains(answer), question[0]).when(~asks & folder.contains(answer), answer).otherwise(f"{question[0]}/{answer}")


def source_from_file(c: Column | str, default: Column | str) -> Column:
    """The middle of ``<13 digits>_<source>_export_all`` in a file name."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "(\\d{13})_(.*?)_export_all", 2), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def level_and_subject(c: Column | str, relaxed: bool = False) -> tuple[Column, Column]:
    """Level and subject from a folder name such as ``初中数学-12_x``."""
    name = F.regexp_extract(c, "([初高][中][^_-]+?)(?:-\\d+_|_)" if relaxed else "([初高][中][^_-]+?)-\\d+_", 1)
    return F.regexp_extract(name, "^(初中|高中|竞赛)(.+)$", 1), F.regexp_extract(name, "^(初中|高中|竞赛)(.+)$", 2)


def image_target(c: Column | str, question: str = "题目", answer: str = "答案", short_books: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Where an image goes: a folder of its path's last two segments and ``{book}-{last}-{base}.jpg``.

    Paths of ``short_books`` end at the question segment; where neither segment is in a path, the
    question segment is added.
    """
    s = segments(c)
    folders = F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    book = F.coalesce(F.try_element_at(folders, F.lit(1)), F.lit(""))
    at = F.array_position(folders, question).cast("int")
    folders = F.when(book.isin(*short_books) & (at > 0), F.slice(folders, F.lit(1), at)).otherwise(folders) if short_books else folders
    folders = F.when(F.exists(folders, lambda x: x.contains(question) | x.contains(answer)), folders).otherwise(F.concat(folders, F.array(F.lit(question))))
    two = F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), F.lit(2))
    name = F.concat_ws("-", book, F.try_element_at(folders, F.lit(-1)), stem(F.try_element_at(s, F.lit(-1))))
    return F.array_join(two, "/"), F.concat(name, F.lit(".jpg"))


def prefixed(images: Column | str, *parts: str) -> Column:
    """Image names under a folder, as the pair of lists that tasks carry: images and none."""
    moved = F.transform(images, lambda x: F.concat_ws("/", *(F.lit(p) for p in parts), base_name(x)))
    return F.array(moved, F.array().cast("array<string>"))


def moved_into(images: Column | str, folder: str) -> Column:
    kept = F.filter(images, lambda x: F.trim(x) != "")
    return F.transform(kept, lambda x: F.concat(F.lit(f"{folder}/"), base_name(F.trim(x))))


def absolute(c: Column | str, root: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))


def package_number(c: Column | str, marker: str = "试题包") -> Column:
    """The first folder below a marker segment, ``.`` for a file right in it; null without the marker."""
    s = segments(c)
    at = F.array_position(s, marker).cast("int")
    return F.when(at > 0, F.when(F.size(s) - at > 1, F.try_element_at(s, at + 1)).otherwise("."))


#: fixed values: school levels in the order in which they are tried
LEVELS = ("高中", "初中", "小学")


def batch_level_and_subject(c: Column | str, batch: str) -> tuple[Column, Column]:
    """Level and subject of a folder ``{batch}_{level}{subject}``; of another level, what stands before and
    behind the first underscore, both the whole where there is none. Null without the batch's prefix."""
    c = F.col(c) if isinstance(c, str) else c
    rest = F.when(c.startswith(f"{batch}_"), F.substring(c, len(batch) + 2, 1 << 20))
    level, subject = F.substring_index(rest, "_", 1), F.when(rest.contains("_"), F.regexp_extract(rest, "(?s)^[^_]*_(.*)$", 1)).otherwise(rest)
    for name in reversed(LEVELS):
        level = F.when(rest.startswith(name), name).otherwise(level)
        subject = F.when(rest.startswith(name), F.substring(rest, len(name) + 1, 1 << 20)).otherwise(subject)
    return level, subject


#: fixed values: subjects that go under another name, and those whose two kinds of books share a corpus
SUBJECT_ALIASES = {"道德与法治": "政治"}
CORPORA = {"英语-辅学类": "英语", "英语-刷题类": "英语", "语文-辅学类": "语文", "语文-刷题类": "语文"}


def subject_alias(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*(F.when(c == k, v) for k, v in SUBJECT_ALIASES.items()), c)


def corpus_path(c: Column | str, folder: str) -> Column:
    """The delivered corpus of a subject: ``{folder}/{subject}.txt``."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.coalesce(*(F.when(c == k, v) for k, v in CORPORA.items()), subject_alias(c))
    return F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(".txt"))


def names_joined(images: Column | str) -> Column:
    """Base names of a list of paths joined by ``;``; blank ones don't count. A single path is ``names_joined(array(path))``."""
    kept = F.filter(images, lambda x: F.trim(x) != "")
    return F.array_join(F.transform(kept, lambda x: base_name(F.trim(x))), ";")


def neighbours(images: Column, page: Column, reach: int = 2) -> Column:
    """The images around a page (from 1), clipped to the list; none for a page outside it."""
    low = F.greatest(page - reach, F.lit(1))
    inside = (page >= 1) & (page <= F.size(images))
    return F.when(inside, F.slice(images, low, page + reach - low + 1)).otherwise(F.array().cast("array<string>"))


def neighbours_of_all(images: Column, pages: Column, reach: int = 2) -> Column:
    """Neighbours of several pages, each image once, in order of first mention."""
    return F.array_distinct(F.flatten(F.transform(pages, lambda p: neighbours(images, p, reach))))
