"""A tolerant lexer of build files: commands with their arguments and quoting, blocks, references to variables.

Offsets are bytes of the UTF-8 text: it is read as Latin-1, one character a byte, and decoded again piece by piece.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import model, session

#: Block openers with their closers and the kind of the node that spans them.
BLOCKS = {
    "if": ("endif", "if_condition"), "foreach": ("endforeach", "foreach_loop"), "while": ("endwhile", "while_loop"),
    "function": ("endfunction", "function_def"), "macro": ("endmacro", "macro_def"), "block": ("endblock", "block_def"),
}
_CLOSERS = {c: o for o, (c, _) in BLOCKS.items()}
_TOKEN = re.compile(
    r"(?P<space>\s+)|#\[(?P<ceq>=*)\[.*?\](?P=ceq)\]|(?P<comment>#[^\n]*)|\[(?P<eq>=*)\[(?P<bracket>.*?)\](?P=eq)\]"
    r'|"(?P<quoted>(?:\\.|[^"\\])*)"|(?P<open>\()|(?P<close>\))|(?P<bare>(?:\\.|"(?:\\.|[^"\\])*"(?=[^\s()#])|[^\s()#"\\]++)+)|(?P<other>.)', re.S)
#: A command of bare arguments only, which needs no tokens.
_PLAIN = re.compile(r"\s*+([A-Za-z_][A-Za-z0-9_]*+)\s*+\(([^()#\"\\\[]*+)\)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_REF = re.compile(r"\\.|\$(ENV|CACHE)?\{|\}", re.S)


@dataclass(slots=True)
class Command:
    name: str
    start: int
    end: int
    args: list[tuple[str, str]] = field(default_factory=list)


def _text(latin: str) -> str:
    return latin if latin.isascii() else latin.encode("latin-1").decode("utf-8", "replace")


def commands(data: bytes) -> tuple[list[Command], bool]:
    """The commands in order, and whether some text is none. An argument's kind is bare, quoted or bracket; inner parentheses are bare ones."""
    out: list[Command] = []
    name, depth, errors, now = None, 0, False, None
    latin, at = data.decode("latin-1"), 0
    while at < len(latin):
        if name is None and depth == 0 and (m := _PLAIN.match(latin, at)):
            at = m.end()
            out.append(Command(m.group(1), m.start(1), at, [("bare", _text(v)) for v in m.group(2).split()]))
            continue
        m = _TOKEN.match(latin, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "space" or kind == "comment" or kind == "ceq":
            continue
        if depth == 0:
            if kind == "open" and name is not None:
                now = Command(_text(name.group()), name.start(), m.end())
                out.append(now)
                depth, name = 1, None
            else:
                good = kind == "bare" and _NAME.match(m.group())
                errors |= name is not None or not good
                name = m if good else None
            continue
        now.end = m.end()
        if kind == "close":
            depth -= 1
            if depth:
                now.args.append(("bare", ")"))
        elif kind == "open":
            depth += 1
            now.args.append(("bare", "("))
        elif kind == "bracket" or kind == "quoted":
            now.args.append((kind, _text(m.group(kind))))
        else:
            now.args.append(("bare", _text(m.group())))
    return out, errors or depth > 0 or name is not None


def references(text: str) -> tuple[list[str], list[str]]:
    """Names of ${X} and $CACHE{X}, and of $ENV{X}, innermost first; a name made by another reference is left out."""
    names, env, stack = [], [], []
    for m in _REF.finditer(text):
        if m.group().startswith("$"):
            stack.append([m.end(), False, m.group(1)])
        elif m.group() == "}" and stack:
            start, dynamic, kind = stack.pop()
            name = text[start : m.start()]
            if not dynamic and name and "$" not in name:
                (env if kind == "ENV" else names).append(name)
            if stack:
                stack[-1][1] = True
    return names, env


def parse(data: bytes) -> tuple[list[tuple], list[tuple], bool]:
    """Rows of nodes and commands of one file, without recording and file. A block's node lasts from its opener to its closer."""
    found, errors = commands(data)
    breaks = [m.start() for m in re.finditer(b"\n", data)]
    nodes, rows, stack = [], [], []

    def add(kind: str, start: int, end: int, parent: int | None) -> int:
        row = bisect.bisect_left(breaks, start)
        nodes.append([len(nodes) + 1, kind, start, end, row + 1, start - (breaks[row - 1] + 1 if row else 0) + 1, parent])
        return len(nodes)

    for c in found:
        low = c.name.lower()
        if low in BLOCKS:
            stack.append((low, add(BLOCKS[low][1], c.start, c.end, stack[-1][1] if stack else None), " ".join(v for _, v in c.args)))
        node = add(f"{low}_command" if low in BLOCKS or low in _CLOSERS or low in ("else", "elseif") else "command", c.start, c.end, stack[-1][1] if stack else None)
        words = " ".join([v for _, v in c.args])
        live = [references(v) for k, v in c.args if k != "bracket" and "$" in v] if "$" in words else ()
        rows.append((node, c.name, low, words, c.args, nodes[node - 1][4], c.start, c.end, [n for a, _ in live for n in a], [n for _, a in live for n in a], [(BLOCKS[o][1], b, head) for o, b, head in stack]))
        if low in _CLOSERS and _CLOSERS[low] in [s for s, _, _ in stack]:
            while True:
                opener, block, _ = stack.pop()
                nodes[block - 1][3] = c.end
                if opener == _CLOSERS[low]:
                    break
    errors |= bool(stack)
    for _, block, _ in stack:
        nodes[block - 1][3] = len(data)
    return [tuple(n) for n in nodes], rows, errors


_OUT = "recording string, file string, content string, content_hash string, has_errors int, nodes array<struct<node_id:bigint,kind:string,byte_start:bigint,byte_end:bigint,line:bigint,col:bigint,parent_id:bigint>>, commands array<struct<node_id:bigint,name:string,name_lower:string,args_text:string,args:array<struct<kind:string,value:string>>,line:bigint,byte_start:bigint,byte_end:bigint,var_refs:array<string>,env_refs:array<string>,blocks:array<struct<kind:string,node_id:bigint,head:string>>>>"
_STR, _INT = pa.string(), pa.int64()
_NODES = pa.list_(pa.struct([("node_id", _INT), ("kind", _STR), ("byte_start", _INT), ("byte_end", _INT), ("line", _INT), ("col", _INT), ("parent_id", _INT)]))
_COMMANDS = pa.list_(pa.struct([
    ("node_id", _INT), ("name", _STR), ("name_lower", _STR), ("args_text", _STR), ("args", pa.list_(pa.struct([("kind", _STR), ("value", _STR)]))), ("line", _INT), ("byte_start", _INT), ("byte_end", _INT),
    ("var_refs", pa.list_(_STR)), ("env_refs", pa.list_(_STR)), ("blocks", pa.list_(pa.struct([("kind", _STR), ("node_id", _INT), ("head", _STR)])))]))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["recording", "file", "content", "content_hash", "has_errors", "nodes", "commands"]
    for b in batches:
        hashes, errors, nodes, rows = [], [], [], []
        for content in b.column("content").to_pylist():
            data = (content or "").encode()
            n, c, e = parse(data)
            hashes.append(hashlib.sha256(data).hexdigest())
            errors.append(int(e))
            nodes.append(n)
            rows.append(c)
        made = [pa.array(hashes, _STR), pa.array(errors, pa.int32()), pa.array(nodes, _NODES), pa.array(rows, _COMMANDS)]
        yield pa.RecordBatch.from_arrays([b.column("recording"), b.column("path"), b.column("content"), *made], names)


def tables(sources: DataFrame, source_dir: str, build_dir: str | None = None) -> dict[str, DataFrame]:
    """files, nodes and commands of sources (recording, path, content). Each file is parsed once, and the three tables read what came out."""
    session.ship(sources.sparkSession)
    # parsing costs far more than the bytes it reads, so files are dealt to all tasks however few blocks hold them
    dealt = sources.select("recording", "path", "content").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "recording", "path")
    parsed = session.cut(dealt.mapInArrow(_parse_batches, _OUT))
    root = source_dir.rstrip("/") + "/"
    own = F.col("path").startswith(root)
    if build_dir:
        own &= ~F.col("path").startswith(build_dir.rstrip("/") + "/")
    files = parsed.select("recording", F.col("file").alias("path"), "content_hash", "has_errors", "content").withColumn("in_source", own.cast("int"))
    files = files.withColumn("content", F.when(F.col("in_source") == 1, F.col("content")))
    nodes = parsed.select("recording", "file", F.explode("nodes").alias("n")).select("recording", "file", "n.*")
    cmds = parsed.select("recording", "file", F.explode("commands").alias("c")).select("recording", "file", "c.*")
    return {"files": files.select(*model.columns("files")), "nodes": nodes, "commands": cmds}


def discover(spark: SparkSession, source_dir: str, recording: str, skip: list[str] | None = None) -> DataFrame:
    """recording, path, content of build files below a folder: CMakeLists.txt and *.cmake, without those whose stem has another extension."""
    name = F.substring_index("path", "/", -1)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source_dir)
    raw = raw.withColumn("path", F.regexp_replace("path", "^file:", "")).where((name == "CMakeLists.txt") | name.rlike(r"^[^.]+\.cmake$")).where(~F.col("path").contains("/.git/"))
    for folder in skip or []:
        raw = raw.where(~F.col("path").startswith(folder.rstrip("/") + "/"))
    return raw.select(F.lit(recording).alias("recording"), "path", F.col("content").cast("string").alias("content"))
