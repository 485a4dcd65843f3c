"""Native column functions on text. None of them runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for trimming: what Java's \\s has, and the other Unicode spaces.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same as signs.
WHITE = "\t\n\x0b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = "[.!?。！？…]+"
HEADING = r"^(#{1,6})\s+(.+)$"
ORDERED_ITEM = r"^\s{0,3}(\d+)\.\s+(\S.*)$"
IMAGE_LINE = r"^\s*!\[([^\]]*)\]\(([^)]+)\)\s*$"
HANGUL = r"\uAC00-\uD7A3"
HANGUL_ALL = r"\uAC00-\uD7A3\u3130-\u318F\u1100-\u11FF"

# Korean terms and the English words that are added for them.
GLOSSARY = [
    ("파티션", "partition"), ("워터마킹", "watermarking"), ("스마트 싱크", "smart sink"), ("싱크", "sink"), ("인제스트", "ingest"), ("임베딩", "embedding"), ("임베드", "embed"), ("검색", "search retrieval"), ("파이프라인", "pipeline"), ("라우팅", "routing"),
    ("중복", "duplicate deduplication"), ("청크", "chunk"), ("벡터", "vector"), ("색인", "index"), ("요약", "summary"), ("복원", "restore"), ("계층", "layer hierarchy"), ("도메인", "domain"), ("컬렉션", "collection"), ("스키마", "schema"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(s: Column) -> Column:
    """s without white space at its ends."""
    return F.btrim(s, F.lit(WHITE))


def blank(s: Column) -> Column:
    return F.coalesce(trim_ws(s), F.lit("")) == ""


def or_else(s: Column, *others: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.try_element_at(F.filter(F.array(s, *others), lambda x: ~blank(x)), F.lit(1))


def or_empty(*values: Column) -> Column:
    """The first that is neither null nor blank, else ''."""
    return F.coalesce(or_else(*values), F.lit(""))


def lines(s: Column) -> Column:
    return F.split(s, "\n", -1)


def strip_headings(s: Column) -> Column:
    """S without the lines that start with # (after white space)."""
    return F.array_join(F.filter(lines(s), lambda x: ~F.startswith(trim_ws(x), F.lit("#"))), "\n")


def first_heading(s: Column) -> Column:
    """The first ATX heading line, trimmed; '' if there is none."""
    found = F.filter(F.transform(lines(s), trim_ws), lambda x: x.rlike(HEADING))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def split_heading(s: Column) -> Column:
    """struct<heading, body>: a leading heading line and the trimmed rest; heading '' if the first line is none."""

    def parts(held: Column) -> Column:
        first = trim_ws(F.get(held, F.lit(0)))
        rest = trim_ws(F.array_join(F.slice(held, F.lit(2), F.greatest(F.size(held) - 1, F.lit(0))), "\n"))
        has = first.rlike(HEADING)
        return F.struct(F.when(has, first).otherwise("").alias("heading"), F.when(has, rest).otherwise(trim_ws(s)).alias("body"))

    return let(lines(s), parts)


def intro(s: Column) -> Column:
    """What stands before the first heading, trimmed; all of s if it has none."""

    def before(held: Column) -> Column:
        at = F.array_position(F.transform(held, lambda x: trim_ws(x).rlike(HEADING)), F.lit(True))
        return let(at, lambda n: F.when(n > 0, F.array_join(F.slice(held, F.lit(1), (n - 1).cast("int")), "\n")).otherwise(s))

    return trim_ws(let(lines(s), before))


def truncate_bytes(s: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most `most` bytes; s itself if most <= 0."""
    if most <= 0:
        return s

    def cut(whole: Column) -> Column:
        raw = F.encode(whole, "UTF-8")
        cuts = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
        return F.when(F.octet_length(whole) <= most, whole).otherwise(F.coalesce(*cuts, F.lit("")))

    return let(s, cut)


def snippet(s: Column, most: int) -> Column:
    """At most `most` characters and an ellipsis; cut after the last sentence end in the last 60 %, else at the last white space there."""
    least = int(most * 0.4)

    def shorten(full: Column) -> Column:
        def end(cut: Column) -> Column:
            by_sentence = F.regexp_extract(cut, rf"(?s)^(.{{{least},}}[.?!。\n])", 1)
            by_space = F.regexp_extract(cut, rf"(?s)^(.{{{least},}}){SPACE}", 1)
            return trim_ws(or_else(by_sentence, by_space, cut))

        return F.when(F.length(full) <= most, full).otherwise(F.concat(let(F.substring(full, 1, most), end), F.lit("…")))

    return let(trim_ws(s), shorten)


def breadcrumb(title: Column, heading: Column, document: str = "문서", section: str = "섹션") -> Column:
    """[document: title] > [section: heading], with marks for what is blank."""
    return F.concat(F.lit(f"[{document}: "), F.coalesce(or_else(trim_ws(title)), F.lit("(untitled)")), F.lit(f"] > [{section}: "), F.coalesce(or_else(trim_ws(heading)), F.lit("(section)")), F.lit("]"))


def annotate_terms(s: Column, glossary: list[tuple[str, str]] | None = None) -> Column:
    """S and, in brackets, the English words of the glossary's terms that it contains (also inside other words)."""
    terms = GLOSSARY if glossary is None else glossary
    if not terms:
        return s

    def added(whole: Column) -> Column:
        found = F.array_join(F.array_compact(F.array(*(F.when(whole.contains(k), F.lit(v)) for k, v in terms))), " ")
        return let(found, lambda f: F.when(f == "", whole).otherwise(F.concat(whole, F.lit(" [en: "), f, F.lit("]"))))

    return let(s, added)


def sentences(s: Column) -> Column:
    """U5 without masks: non-blank parts between runs of sentence ends, trimmed; the ends are lost."""
    unified = F.regexp_replace(s, "\r\n?", "\n")
    return F.filter(F.transform(F.split(unified, SENTENCE_END, -1), trim_ws), lambda x: x != "")


def summary_of_section(title: Column, path: Column, text: Column, most: int = 400) -> Column:
    """Title | path — the first two sentences (or the body), annotated and cut at `most` bytes."""

    def start(body: Column) -> Column:
        return let(F.array_join(F.slice(sentences(body), 1, 2), ". "), lambda two: or_empty(trim_ws(two), body))

    short = truncate_bytes(annotate_terms(let(trim_ws(strip_headings(text)), start)), most)
    head = F.concat_ws(" | ", F.when(~blank(title), trim_ws(title)), F.when(path != "", path))
    return F.when(head == "", short).otherwise(F.concat(head, F.lit(" — "), short))


def summary_of_document(title: Column, summaries: Column, most: int = 1200) -> Column:
    """A5: title: section summaries, in order, until `most` bytes are passed; cut there. A null title counts as ''."""
    name = F.coalesce(title, F.lit(""))
    start = F.when(name == "", F.lit("")).otherwise(F.concat(name, F.lit(": ")))
    numbered = F.filter(F.transform(summaries, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: F.coalesce(x.getField("s"), F.lit("")) != "")
    joined = F.aggregate(numbered, F.struct(start.alias("t"), F.lit(False).alias("full")), lambda acc, x: F.when(acc.getField("full"), acc).otherwise(_appended(acc.getField("t"), x, most)))
    return trim_ws(truncate_bytes(joined.getField("t"), most))


def _appended(text: Column, x: Column, most: int) -> Column:
    longer = F.concat(text, F.when(x.getField("i") > 0, " ").otherwise(""), x.getField("s"))
    return F.struct(longer.alias("t"), (F.octet_length(longer) > most).alias("full"))


def declared_name(line: Column) -> Column:
    """The name that a line of code declares; else its first word; else the line."""
    s = trim_ws(line)
    name = F.regexp_extract(s, r"^(?:async def|def|func|class|type|const) ([^(:\[ \t]+)", 1)
    return or_else(name, F.regexp_extract(s, r"^(?:(?:async def|def|func|class|type|const) +)?(\S+)", 1), s)


def strip_hangul_end(token: Column) -> Column:
    """X11: a token without the Hangul at its end."""
    return F.regexp_replace(token, f"[{HANGUL_ALL}]+$", "")


def hangul_ratio(s: Column) -> Column:
    """Hangul syllables in all characters; 0 for ''."""
    return F.length(F.regexp_replace(s, f"[^{HANGUL}]+", "")) / F.greatest(F.length(s), F.lit(1))


def join_path(parts: Column) -> Column:
    """Parts joined by ' > '."""
    return F.array_join(parts, " > ")


def directory(path: Column) -> Column:
    """POSIX directory of a path (backslashes count as slashes); / if there is none."""
    found = F.regexp_extract(F.translate(path, "\\", "/"), r"^(/*.*?)/+[^/]*$", 1)
    return F.when(path.isNotNull(), F.regexp_replace(found, "^$", "/"))


def pipe_cells(line: Column) -> Column:
    """Trimmed cells of a table row; one pipe at either end is left out."""
    return F.transform(F.split(F.regexp_replace(trim_ws(line), r"^\||\|$", ""), r"\|", -1), trim_ws)


def is_separator_row(line: Column) -> Column:
    """Has a pipe, and each cell that is not empty is three or more of - and :."""
    cells = F.transform(pipe_cells(F.regexp_replace(line, " ", "")), trim_ws)
    return trim_ws(line).contains("|") & F.forall(cells, lambda c: (c == "") | c.rlike(r"^[-:]{3,}$"))


def format_table(headers: Column, separator: Column, rows: Column) -> Column:
    """A pipe table from an array of headers, a separator row (made if blank) and an array of rows."""
    head = F.concat(F.lit("| "), F.array_join(headers, " | "), F.lit(" |"))
    rule = or_else(trim_ws(separator), F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit(" --- ")), "|"), F.lit("|")))
    body = trim_ws(F.array_join(rows, "\n"))
    full = F.concat_ws("\n", head, rule, F.when(body != "", body))
    return trim_ws(F.when(F.size(headers) > 0, full).otherwise(body))


def format_code(language: Column, rows: Column) -> Column:
    """Rows in a code fence; as they are if they have one."""
    body = trim_ws(F.array_join(rows, "\n"))
    return F.when(body.startswith("```"), body).otherwise(trim_ws(F.concat(F.lit("```"), F.coalesce(trim_ws(language), F.lit("")), F.lit("\n"), body, F.lit("\n```"))))


def format_block(section_id: Column, block_type: Column, headers: Column, separator: Column, language: Column, atoms: Column) -> Column:
    """The text of one section from its atoms, by the first letter of its id or its block type."""
    kind, code = F.lower(F.coalesce(block_type, F.lit(""))), F.substring(F.coalesce(section_id, F.lit("")), 1, 1)
    is_code = (code == "c") | (kind == "code")
    held = F.filter(atoms, lambda x: ~blank(x))
    trimmed = F.when(is_code, F.transform(held, lambda x: F.regexp_replace(x, r"[\r\n]+\z", ""))).otherwise(F.transform(held, trim_ws))

    def block(kept: Column) -> Column:
        first = F.coalesce(F.get(kept, F.lit(0)), F.lit(""))
        rest = F.array_join(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), " ")
        prose = F.when(first.startswith("#"), F.when(F.size(kept) > 1, F.concat(first, F.lit("\n\n"), rest)).otherwise(first)).otherwise(F.array_join(kept, " "))
        return (
            F.when((code == "t") | (kind == "table"), format_table(headers, separator, kept))
            .when(is_code, format_code(language, kept))
            .when((code == "i") | (kind == "image"), F.array_join(kept, "\n"))
            .when(code.isin("s", "o") | kind.isin("heading", "ordered"), prose)
            .otherwise(F.array_join(kept, "\n\n"))
        )

    return let(trimmed, block)


def join_rows(rows: Column, source_type: Column) -> Column:
    """Non-blank rows, trimmed, joined by a blank line for Markdown kinds and by a newline for others."""
    kept = F.filter(F.transform(rows, trim_ws), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.lower(or_else(source_type, F.lit("md"))).isin("md", "markdown", "wiki"), F.array_join(kept, "\n\n")).otherwise(F.array_join(kept, "\n"))


def decode_summary(blob: Column) -> Column:
    """The text of a UTF-8 blob; '' for null, with marks for bytes that are none."""
    return F.coalesce(F.make_valid_utf8(blob.cast("string")), F.lit(""))


def passage(s: Column) -> Column:
    """What is embedded of a stored text."""
    return F.concat(F.lit("passage: "), s)


def query(s: Column) -> Column:
    """What is embedded of a query."""
    return F.concat(F.lit("query: "), s)


def token_count(s: Column) -> Column:
    """Twice the words, 1 at least."""
    return F.greatest(F.lit(1), 2 * F.size(F.filter(F.split(s, rf"{SPACE}+"), lambda x: x != "")))


def embedding_text(title: Column, content: Column, most: int = 500) -> Column:
    """Title, newline, content cut at `most` bytes."""
    return F.concat(title, F.lit("\n"), truncate_bytes(content, most))


def clauses(s: Column) -> Column:
    """A sentence's parts between , | ; unless it is short (under 120 bytes, no pipe, one comma at most)."""
    return let(trim_ws(s), _clauses)


def _clauses(text: Column) -> Column:
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    short = (F.octet_length(text) < 120) & ~text.contains("|") & (commas <= 1)
    parts = F.filter(F.transform(F.split(text, r"[,|;]", -1), trim_ws), lambda x: x != "")
    several = let(parts, lambda p: F.when(F.size(p) <= 1, F.array(text)).otherwise(p))
    return F.when(text == "", F.array().cast("array<string>")).when(short, F.array(text)).otherwise(several)


def table_rows(markdown: Column) -> Column:
    """U8: the data rows of a pipe table, up to the first line without a pipe; the whole text if there are none."""

    def rows(text: Column) -> Column:
        data = let(F.transform(lines(text), trim_ws), lambda x: F.slice(x, F.lit(3), F.greatest(F.size(x) - 2, F.lit(0))))

        def first(held: Column) -> Column:
            stop = F.array_position(F.transform(held, lambda x: ~x.contains("|")), F.lit(True))
            return let(stop, lambda n: F.when(n > 0, F.slice(held, F.lit(1), (n - 1).cast("int"))).otherwise(held))

        found = let(let(data, first), lambda r: F.when(F.size(r) == 0, F.array(text)).otherwise(r))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(found)

    return let(trim_ws(markdown), rows)


def code_fragments(code: Column) -> Column:
    """Non-blank lines without the outer fences, indentation kept."""
    return let(F.filter(lines(F.regexp_replace(code, "\r\n?", "\n")), lambda x: ~blank(x)), _without_fences)


def _without_fences(body: Column) -> Column:
    open_ = F.coalesce(F.get(body, F.lit(0)), F.lit("")).rlike(r"^\s*```")
    close = F.coalesce(F.try_element_at(body, F.lit(-1)), F.lit("")).rlike(r"^\s*```\s*$")
    first = F.when(open_, 2).otherwise(1)
    size = F.size(body) - F.when(open_, 1).otherwise(0) - F.when(close & (F.size(body) > 1), 1).otherwise(0)
    return F.transform(F.slice(body, first, F.greatest(size, F.lit(0))), lambda x: F.regexp_replace(x, r"\s+$", ""))


def keywords(s: Column, least: int = 4, most: int = 8) -> Column:
    """The first `most` distinct words of letters, digits, _ and -, lower-cased, of `least` characters or more."""
    found = F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) >= least)), 1, most)


def language_of_path(path: Column) -> Column:
    """The language of a file by its suffix; text if it is unknown."""
    known = {"go": ("go",), "python": ("py",), "javascript": ("js", "jsx"), "typescript": ("ts", "tsx"), "java": ("java",), "rust": ("rs",), "c": ("c", "h"), "cpp": ("cpp",)}
    suffix = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    return reduce(lambda acc, kv: acc.when(suffix.isin(*kv[1]), kv[0]), known.items(), F.when(F.lit(False), F.lit(""))).otherwise("text")
