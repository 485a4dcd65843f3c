"""Python and Go source into nested nodes by lines, natively.

Strings and comments are found where their signs stand and blanked, so that nothing in
them counts. What remains gives each line a level: in Python the indentation of the
statement that it begins or continues, in Go the number of open brackets. A node's block is
what follows at higher levels, so the enclosing node of a line is the last one of the
highest lower level that no line of that level or below has closed. That is one window for
each level of a file, over rows of (line, level): the depth of nesting is not bounded.

Windows have a row for each run of lines, not for each line: a statement's first line and a
comment are runs of their own, lines that go on and blank lines run together. Runs are found
within a file by numpy, once: all windows are one chain over them, without a join to themselves.
Lines are spread out last, where their file lies.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.operators.code import code_lines

PY_STRING = rb"""\"{3}(?s:.*?)(?<!\\)(?:\\\\)*\"{3}|'{3}(?s:.*?)(?<!\\)(?:\\\\)*'{3}|\"(?:[^\"\\\n]++|\\(?s:.))*+\"|'(?:[^'\\\n]++|\\(?s:.))*+'"""
#: In Go an escape doesn't reach over an end of line, of which Unicode has more.
GO_ESCAPE = rb"\\(?!\xc2\x85|\xe2\x80[\xa8\xa9])[^\n]"
GO_STRING = rb"""`[^`]*+`|\"(?:[^\"\\\n]++|%b)*+\"|'(?:[^'\\\n]++|%b)*+'""" % (GO_ESCAPE, GO_ESCAPE)
#: Comments and strings (without the letters before them) of each language, and the signs that they begin with; a comment begins with the first sign.
TOKENS = {"python": re.compile(rb"#[^\n]*|" + PY_STRING), "go": re.compile(rb"//[^\n]*|/\*(?s:.*?)\*/|" + GO_STRING)}
SIGNS = {"python": b"#\"'", "go": b"/`\"'"}
PREFIX = b"rbufRBUF"
#: Characters that stand for a string, a comment, and the end of a line within either.
IN_STRING, IN_COMMENT, GOES_ON = "\x01", "\x02", "\x03"

# Node types by how a statement begins, the first that fits.
NODES = {
    "python": [
        (r"^@", "decorated_definition"), (r"^(?:async\s+)?def\b", "function_definition"), (r"^class\b", "class_definition"), (r"^if\b", "if_statement"), (r"^elif\b", "elif_clause"), (r"^else\s*:", "else_clause"),
        (r"^(?:async\s+)?for\b", "for_statement"), (r"^while\b", "while_statement"), (r"^(?:async\s+)?with\b", "with_statement"), (r"^try\s*:", "try_statement"), (r"^except\b", "except_clause"), (r"^match\s+[^=.,)].*:[\s\x02]*$", "match_statement"),
        (r"^finally\s*:", "finally_clause"), (r"^case\s.*:", "case_clause"), (r"^return\b", "return_statement"), (r"^import\b", "import_statement"), (r"^from\b.*\bimport\b", "import_from_statement"), (r"^(?:pass|break|continue|raise|assert|del|global|nonlocal|yield)\b", "simple_statement"),
        (r"^[\w.\[\]\x01, ]+\s*(?:[-+*/%&|^@]|//|\*\*|>>|<<)=", "augmented_assignment"), (r"^[^=(]+(?::[^=]+)?=(?!=)", "assignment"),
    ],
    "go": [
        (r"^func\s*\(", "method_declaration"), (r"^func\s+\w", "function_declaration"), (r"^type\b", "type_declaration"), (r"^const\b", "const_declaration"), (r"^var\b", "var_declaration"), (r"^(?:\}\s*else\s+)?if\b", "if_statement"), (r"^for\b", "for_statement"),
        (r"^switch\b", "switch_statement"), (r"^select\b", "select_statement"), (r"^go\b", "go_statement"), (r"^defer\b", "defer_statement"), (r"^\}\s*else\b", "else_block"), (r"^import\b", "import_declaration"), (r"^package\b", "package_clause"), (r"^return\b", "return_statement"),
        (r"^(?:case\b|default\s*:)", "case_clause"), (r"^[\w, ]+:=", "short_var_declaration"), (r"^[^=(]+[^=!<>:]=(?!=)", "assignment"),
    ],
}
ANCHORS = {
    "python": ["decorated_definition", "function_definition", "class_definition", "if_statement", "elif_clause", "else_clause", "for_statement", "while_statement", "with_statement", "try_statement", "except_clause", "match_statement"],
    "go": ["function_declaration", "method_declaration", "type_declaration", "const_declaration", "var_declaration", "if_statement", "for_statement", "switch_statement", "select_statement", "go_statement", "defer_statement"],
}
#: Statements that begin a block if they go on over lines.
BLOCK_STARTS = ["return_statement", "expression_statement", "assignment", "augmented_assignment", "short_var_declaration"]
#: Nodes of the table of contents, and those of them that have a name (the others are called by their first line).
TOP = ["function_definition", "class_definition", "decorated_definition", "function_declaration", "method_declaration", "type_declaration", "const_declaration", "var_declaration", "import_declaration", "package_clause"]
NAMED = ["function_definition", "class_definition", "function_declaration"]
#: Of a clause that is no node: the node of the same level that it belongs to.
OWNERS = {"finally_clause": "try_statement", "decorator": "decorated_definition", "else_block": "if_statement"}


def _among(signs: bytes) -> bytes:
    """A table for translate: 1 for each of the signs, 0 for others."""
    return bytes(c in signs for c in range(256))


_SIGN = {lang: _among(signs) for lang, signs in SIGNS.items()}


def _places(code: bytes, table: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(code.translate(table), bool))


def _in_word(code: bytes, at: int) -> bool:
    """Does a letter at this place belong to a word that began before?"""
    before = code[max(0, at - 32) : at].decode("utf-8", "ignore")
    while before and unicodedata.category(before[-1]) == "Mn":
        before = before[:-1]
    return before != "" and (before[-1] == "_" or unicodedata.category(before[-1]) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"))


def _blanked(code: bytes, lang: str) -> bytes:
    """The text with each string and comment replaced by marks; lines stay lines."""
    out, end = [], 0
    for at in _places(code, _SIGN[lang]).tolist():
        token = TOKENS[lang].match(code, at) if at >= end else None
        if token is None:
            continue
        begin, comment = at, code[at] == SIGNS[lang][0]
        if lang == "python" and not comment:
            begin = next((at - k for k in (2, 1) if at - k >= end and not code[at - k : at].strip(PREFIX) and not _in_word(code, at - k)), at)
        mark = (IN_COMMENT if comment else IN_STRING).encode()
        if b"\n" in token[0]:
            mark = re.sub(rb"[^\n]+", IN_STRING.encode(), token[0]).replace(b"\n", f"{GOES_ON}\n".encode())
        out += [code[end:begin], mark]
        end = token.end()
    return b"".join([*out, code[end:]]) if out else code


def _indent(line: Column) -> Column:
    """Columns before the first character, a tab up to the next multiple of eight (behind less than eight spaces)."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^([ \t\f]*)", 1), r" {0,7}\t", " " * 8))


_MARKS = np.zeros(256, np.int8)
_MARKS[[*b"([{"]], _MARKS[[*b")]}"]] = 1, -1
_BRACKETS = _among(b"([{}])")
#: Last bytes of lines that must be looked at one by one: white space, or what may be part of it, and marks.
_UNSURE = np.zeros(256, bool)
_UNSURE[[ord(c) for c in f"{X.WHITE}{IN_COMMENT}{GOES_ON}" if ord(c) < 128 and c != "\n"]] = True
_UNSURE[128:] = True
BLANK, NOTE, ON, HEAD = range(4)


def _runs_of(code: bytes, python: bool) -> tuple[np.ndarray, ...]:
    """Of blanked code its runs: first line, where it begins and ends, lines, kind, open brackets before the first line, those that it opens, and whether the line after it that is neither blank nor a comment goes on."""
    data = np.frombuffer(code + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    n, starts = len(ends), np.r_[0, ends[:-1] + 1]
    at = _places(code, _BRACKETS)
    opened = np.bincount(np.searchsorted(ends, at), _MARKS[data[at]], n).astype(np.int64)
    depth = np.cumsum(opened) - opened
    last = data[ends - 1]  # of an empty line the line end before it
    blank, slashed, bare = last == 10, last == 92, np.zeros(n, bool)
    for i in np.flatnonzero(_UNSURE[last]).tolist():
        line = code[starts[i] : ends[i]].decode("utf-8", "replace").strip(X.WHITE)
        blank[i], slashed[i], bare[i] = not line, line.endswith("\\"), not line.strip(f"{X.WHITE}{IN_COMMENT}{GOES_ON}")
    inside = np.r_[False, last[:-1] == 3]
    on = inside | (depth > 0) | np.r_[False, slashed[:-1]] if python else inside
    kind = np.full(n, HEAD, np.int8)
    kind[bare], kind[on], kind[blank & ~inside] = NOTE, ON, BLANK
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NOTE) | (kind[1:] == HEAD)])
    lines, run = np.diff(np.r_[first, n]), kind[first]
    after = np.minimum.accumulate(np.where((run == ON) | (run == HEAD), np.arange(len(run)), len(run))[::-1])[::-1]
    more = (run == ON) & (lines > 1) | (np.r_[run, HEAD][np.r_[after[1:], len(run)]] == ON)
    return first, starts[first], ends[first], lines, run, depth[first], opened[first], more


def _runs(lang: str):
    """key, text -> key, _i, _n, _run, _depth, _opened, _more, _code (of heads and comments)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whose, held, own = [], [], []
            for r in range(len(b)):
                text = b.column(1)[r].as_buffer().to_pybytes()
                if text:
                    code = _blanked(text, lang)
                    first, starts, ends, *rest = _runs_of(code, lang == "python")
                    whose.append(np.full(len(first), r))
                    held.append((first, *rest))
                    own += [code[i:j].decode("utf-8", "replace") if k in (NOTE, HEAD) else None for i, j, k in zip(starts.tolist(), ends.tolist(), rest[1].tolist(), strict=True)]
                if held and (len(own) > 20_000 or r == len(b) - 1):
                    *numbers, more = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(whose))), *(pa.array(x, pa.int32()) for x in numbers), pa.array(more), pa.array(own, pa.string())], ["key", "_i", "_n", "_run", "_depth", "_opened", "_more", "_code"])
                    whose, held, own = [], [], []

    return apply


def placed(key: str) -> Column:
    """What parse_lines deals texts out by: rows that are dealt by it before their text is made need not move again. Null keys have a place too."""
    return F.xxhash64(key)


def parse_lines(df: DataFrame, key: str, content: str, lang: str) -> DataFrame:
    """key, line_num (from 1), content, node_type, is_anchor, is_block_start, parent_idx, scope_idx of each line of Python or Go.

    An anchor is a line on which a declaration or a compound statement begins. parent_idx is
    the index (from 0) of the anchor that a line which is none lies in (a blank line: of the last
    anchor above), else -1; scope_idx is the index of the anchor around any line, anchors
    too. is_block_start: an anchor or a plain statement that goes on over more lines.
    """
    if lang not in NODES:
        raise ValueError(f"no parser for {lang}")
    # regular expressions only for texts that need them
    text = F.coalesce(content, F.lit(""))
    files = df.select(key, text.alias("_t")).select(key, F.when(F.contains("_t", F.lit("\r")), F.regexp_replace("_t", "\r\n?", "\n")).otherwise(F.col("_t")).alias("_t"))
    files = files.select(key, F.when(F.endswith("_t", F.lit("\n")), F.regexp_replace("_t", r"\n\z", "")).otherwise(F.col("_t")).alias("_t"))
    type_ = files.schema[0].dataType.simpleString()
    found = files.mapInArrow(_runs(lang), f"key {type_}, _i int, _n int, _run int, _depth int, _opened int, _more boolean, _code string")
    rows = found.select(F.col("key").alias(key), *found.columns[1:])
    order = Window.partitionBy(key).orderBy("_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    code = F.regexp_replace("_code", "[\x03]+$", GOES_ON)
    rows = rows.withColumn("_s", X.trim_ws(F.trim(F.regexp_replace(code, r"[\x02\x03]", " "))))
    if lang == "python":
        level = _indent(F.col("_code"))
    else:
        level = F.col("_depth") - F.length(F.regexp_replace(F.regexp_extract("_s", r"^([)\]}\s]*)", 1), r"\s", ""))
    rows = rows.withColumns({"_blank": F.col("_run") == BLANK, "_note": F.col("_run") == NOTE, "_on": F.col("_run") == ON, "_head": F.col("_run") == HEAD})
    kind: Column = F.when(F.col("_blank"), "empty_line").when(F.col("_note"), "comment").when(F.col("_on"), "continuation")
    for pattern, node in NODES[lang]:
        kind = kind.when(F.col("_s").rlike(pattern), node)
    rows = rows.withColumn("_kind", kind.otherwise("expression_statement"))
    rows = rows.withColumn("_level", F.when(F.col("_head") | F.col("_note"), level))
    closer = F.col("_head") & F.col("_s").rlike(r"^[)\]}]") & ~F.col("_kind").isin("else_block", "if_statement") if lang == "go" else F.lit(False)
    opens = (F.col("_opened") > 0) if lang == "go" else F.lit(False)
    ends_open = F.coalesce(F.col("_s").rlike(r"[{(\[]$"), F.lit(False)) if lang == "go" else F.lit(False)
    rows = rows.select(key, "_i", "_n", "_blank", "_note", "_on", "_head", "_kind", "_level", "_more", closer.alias("_closes"), opens.alias("_opens"), ends_open.alias("_ends_open"))
    above = F.last(F.when(F.col("_head"), F.struct("_kind", "_level")), ignorenulls=True).over(before)
    rows = rows.withColumn("_above", above)
    again = F.col("_head") & (F.col("_kind") == "decorated_definition") & (F.col("_above._kind") == "decorated_definition") & (F.col("_above._level") == F.col("_level"))
    rows = rows.withColumn("_kind", F.when(again, "decorator").otherwise(F.col("_kind"))).drop("_above")
    rows = rows.withColumn("_anchor", F.col("_head") & F.col("_kind").isin(ANCHORS[lang]))
    same = Window.partitionBy(key, "_level").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.lit(None).cast("int")
    for clause, node in OWNERS.items():
        owner = F.when(F.col("_kind") == clause, F.last(F.when(F.col("_kind") == node, F.col("_i")), ignorenulls=True).over(same)).otherwise(owner)
    rows = rows.withColumn("_node", F.when(F.col("_anchor"), F.col("_i")).otherwise(owner))
    # heads and comments ask each level of their file, other runs none
    rows = rows.withColumn("_levels", F.collect_set(F.when(F.col("_head"), F.col("_level"))).over(Window.partitionBy(key)))
    by_level = rows.withColumn("_at", F.explode_outer(F.when(F.col("_level").isNotNull(), F.col("_levels")))).drop("_levels")
    state = F.when((F.col("_at") >= F.col("_level")) & F.col("_head"), F.struct(F.when(F.col("_at") == F.col("_level"), F.col("_node")).alias("node")))
    held = F.last(state, ignorenulls=True).over(Window.partitionBy(key, "_at").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    seen = by_level.withColumn("_in", held.getField("node"))
    sought = (F.col("_at") < F.col("_level")) | (F.col("_closes") & (F.col("_at") == F.col("_level")))
    kept = [c for c in rows.columns if c not in (key, "_i", "_levels")]
    scopes = seen.groupBy(key, "_i").agg(F.max_by(F.when(sought, F.col("_in")), F.when(sought & F.col("_in").isNotNull(), F.col("_at"))).alias("_scope"), *(F.first(c).alias(c) for c in kept))
    full = scopes.withColumnsRenamed({"_kind": "node_type", "_anchor": "is_anchor"})
    # a line that goes on lies in its statement if that is an anchor, else where the statement lies; a clause that belongs to a node lies in it
    begun = F.last(F.when(F.col("_head"), F.struct(F.coalesce("_node", "_scope").alias("p"))), ignorenulls=True).over(order).getField("p")
    anchored = F.last(F.when(F.col("is_anchor"), F.col("_i")), ignorenulls=True).over(before)
    scope = F.when(F.col("_blank"), anchored).when(F.col("_on"), begun).when(F.col("is_anchor"), F.col("_scope")).otherwise(F.coalesce("_node", "_scope"))
    more = F.col("_more")
    if lang == "python":
        # backwards, as a window up to the end would be summed anew for each row
        below = Window.partitionBy(key).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
        following = F.last(F.when(F.col("_on") | F.col("_head"), F.struct("_level", "node_type")), ignorenulls=True).over(below)
        belongs = (following.getField("_level") == F.col("_level")) & (following.getField("node_type").isin("elif_clause", "else_clause", "except_clause", "finally_clause") | (F.col("node_type") == "decorated_definition"))
        spans = more | (following.getField("_level") > F.col("_level")) | belongs
    else:
        spans = more | F.col("_opens") | F.col("_ends_open")
        more = more | F.col("_opens")
    block = F.when(F.col("is_anchor"), spans).otherwise(F.col("node_type").isin(BLOCK_STARTS) & more)
    scoped = F.coalesce(scope, F.lit(-1))
    runs = full.select(F.col(key).alias("_key"), F.struct("_i", "_n", "node_type", "is_anchor", F.coalesce(block, F.lit(False)).alias("is_block_start"), F.when(F.col("is_anchor"), -1).otherwise(scoped).alias("parent_idx"), scoped.alias("scope_idx")).alias("_r"))
    held = runs.groupBy("_key").agg(F.array_sort(F.collect_list("_r")).alias("_runs"))
    one = F.coalesce(F.col(key) == F.col("_key"), F.col(key).isNull() & F.col("_key").isNull())
    both = files.join(held.hint("shuffle_hash"), (placed(key) == placed("_key")) & one)
    # exploded, the array of lines is made once a file; as a mere column it would be made again for each run
    split = both.select(key, "_runs", F.explode(F.array(F.split("_t", "\n", -1))).alias("_lines")).select(key, "_lines", F.explode("_runs").alias("_r"))
    each = split.select(key, "_r", F.posexplode(F.slice("_lines", F.col("_r._i") + 1, F.col("_r._n"))).alias("_at", "content"))
    return each.select(key, (F.col("_r._i") + F.col("_at") + 1).alias("line_num"), "content", *(F.col(f"_r.{c}").alias(c) for c in ("node_type", "is_anchor", "is_block_start", "parent_idx", "scope_idx")))


def parse_toc(lines: DataFrame, key: str) -> DataFrame:
    """key, text, level 2, node_type, start_line, end_line of the declarations that lie in no other node (lines as of parse_lines; a decorated definition is one entry, with its decorator's line as its text)."""
    order = Window.partitionBy(key).orderBy("line_num")
    outer = (F.col("scope_idx") == -1) & ~F.col("node_type").isin("empty_line", "comment", "continuation") & ~F.col("content").rlike(r"^\s|^[)\]}]")
    under = F.coalesce(F.lag("node_type").over(order).isin("decorated_definition", "decorator", "continuation") & (F.col("_deco") == 1), F.lit(False))
    rows = lines.withColumn("_outer", outer)
    recent = F.last(F.when(F.col("_outer") & (F.col("node_type") != "decorator"), F.struct(F.when(F.col("node_type") == "decorated_definition", 1).otherwise(0).alias("d"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).getField("d")
    rows = rows.withColumn("_deco", recent).withColumn("_begins", F.col("_outer") & (F.col("node_type") != "decorator") & ~under)
    rows = rows.withColumn("_no", F.sum(F.col("_begins").cast("int")).over(order))
    held = rows.where((F.col("_no") > 0) & ~F.col("node_type").isin("empty_line", "comment")).groupBy(key, "_no")
    first = held.agg(F.min(F.struct("line_num", "node_type", "content")).alias("f"), F.max("line_num").alias("end_line"))
    name = F.regexp_extract("f.content", r"^(?:async\s+)?(?:def|class|func)\s+(\w+)", 1)
    text = F.when(F.col("f.node_type").isin(NAMED), name).otherwise(F.substring("f.content", 1, 80))
    return first.where(F.col("f.node_type").isin(TOP)).select(key, text.alias("text"), F.lit(2).alias("level"), F.col("f.node_type").alias("node_type"), F.col("f.line_num").alias("start_line"), "end_line")


def source_lines(df: DataFrame, key: str, content: str, lang: str) -> DataFrame:
    """Lines of files whose language is named by the column `lang`: python and go as of parse_lines, others as of code.code_lines."""
    other = code_lines(df.where(~F.coalesce(F.col(lang), F.lit("")).isin(*NODES)), key, content).withColumn("scope_idx", F.col("parent_idx"))
    for name in NODES:
        other = other.unionByName(parse_lines(df.where(F.col(lang) == name), key, content, name))
    return other


def source_json(df: DataFrame, key: str, content: str, lang: str) -> DataFrame:
    """Key, json: each file's table of contents and lines as one JSON text."""
    lines = source_lines(df, key, content, lang)
    entry = F.struct("line_num", "content", "node_type", "is_anchor", "is_block_start", "parent_idx")
    held = lines.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    toc = parse_toc(lines, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text", "level", "node_type"))).alias("toc"))
    both = df.select(key).join(held, key, "left").join(toc, key, "left")
    empty = F.array()
    return both.select(key, F.to_json(F.struct(F.coalesce("toc", empty.cast(toc.schema["toc"].dataType)).alias("toc"), F.coalesce("lines", empty.cast(held.schema["lines"].dataType)).alias("lines"))).alias("json"))
