"""The replay of recordings: scopes by depth, then each event's reads, then its writes.

A recording's events must be seen in order, so one task replays one recording; many run side by side. Rows stream in
batches: a task holds the state of one recording (open scopes, their variables, the cache), never its events. A task
that is lost starts its recordings again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import model, session
from tracemill.replay import effects as E

LOG = "recording string, what string, id bigint, event_id bigint, scope_id bigint, name string, a string, b string, c string, ref bigint, flag int, params array<string>"
_NAMES = [f.split()[0] for f in LOG.split(", ")]
TRANSPARENT = {"macro", "include", "unknown"}
ROOT = 1


class _Scope:
    __slots__ = ("id", "kind", "depth", "transparent", "vars", "span")

    def __init__(self, id, kind, depth, transparent, span=None):
        self.id, self.kind, self.depth, self.transparent, self.span = id, kind, depth, transparent, span
        self.vars: dict[str, int] = {}


class Replay:
    """The state of one recording. step() takes one event; finish() closes what is open; both append to rows."""

    def __init__(self, recording: str, seeds: list[tuple[str, str]] = ()):
        self.recording, self.rows = recording, []
        self.count = dict.fromkeys(("scope", "write", "read", "def", "edge", "prop"), 0)
        self.cache: dict[str, int] = {}
        self.env: dict[str, int | None] = {}
        self.known: dict[str, tuple[str, list[str]]] = {}
        self.seeds, self.opener, self.last = list(seeds), None, None
        self.stack = [self._open("directory", "", 1, False, None)]

    def _emit(self, what, event, scope=None, name=None, a=None, b=None, c=None, ref=None, flag=None, params=None, id=None):
        self.rows.append((self.recording, what, id, event, scope, name, a, b, c, ref, flag, params))

    def _next(self, what):
        self.count[what] += 1
        return self.count[what]

    def _open(self, kind, name, depth, transparent, event, span=None):
        s = _Scope(self._next("scope"), kind, depth, transparent, span)
        parent = self.stack[-1].id if s.id > ROOT else None
        chain = [*(self.stack if parent else []), s]
        self._emit("scope", event, s.id, name, kind, ref=parent, flag=int(transparent), params=[f"{c.id}:{c.kind}" for c in chain], id=s.id)
        return s

    def _close(self, event):
        self._emit("close", event, id=self.stack.pop().id)

    def _write(self, event, scope, name, value, kind):
        w = self._next("write")
        self._emit("write", event, scope, name, value, kind, id=w)
        return w

    def _find(self, name):
        for s in reversed(self.stack):
            # a macro's own table holds its parameters only
            if name in s.vars and (s.kind == "macro" or not s.transparent):
                return s.vars[name]
        return self.cache.get(name)

    def _read(self, event, name, kind, force):
        w = self._find(name)
        if w is not None or force:
            self._emit("read", event, self.stack[-1].id, name, kind, ref=w, id=self._next("read"))

    def _call(self, cmd, args):
        """Kind, name, parameters and arguments of the scope that this event may open."""
        if cmd == "cmake_language" and len(args) > 1 and args[0].upper() == "CALL":
            kind, params = self.known.get(args[1].lower(), ("unknown", []))
            return kind, args[1], params, args[2:]
        if cmd == "add_subdirectory":
            return "directory", args[0] if args else "", [], []
        if cmd in self.known:
            return self.known[cmd][0], cmd, self.known[cmd][1], args
        if cmd in ("try_compile", "try_run"):
            return "try_compile", cmd, [], []
        return "include" if cmd in E.INCLUDERS else "unknown", args[0] if args else cmd, [], []

    def _scopes(self, e):
        while len(self.stack) > 1:
            top = self.stack[-1]
            left = top.depth > e.global_frame
            if top.kind == "block" and top.depth == e.global_frame and top.span:
                file, start, end = top.span
                left |= file != e.file or (e.byte_start is not None and not start <= e.byte_start < end)
            if not left:
                break
            self._close(self.last)
        if self.opener:
            event, depth, (kind, name, params, args) = self.opener
            if depth + 1 == e.global_frame:
                s = self._open(kind, name, e.global_frame, kind in TRANSPARENT, event)
                self.stack.append(s)
                if kind in ("function", "macro"):
                    given = {p: args[i] if i < len(args) else "" for i, p in enumerate(params)}
                    given |= {"ARGC": str(len(args)), "ARGV": ";".join(args), "ARGN": ";".join(args[len(params) :])} | {f"ARGV{i}": a for i, a in enumerate(args)}
                    for n, v in given.items():
                        s.vars[n] = self._write(event, s.id, n, v, "synthetic")

    def _store(self, event, w):
        inside_try = any(s.kind == "try_compile" for s in self.stack)
        opaque = [s for s in reversed(self.stack) if not s.transparent]
        if w.kind == "env":
            id = self._write(event, None, w.name, w.value, "env")
            if not inside_try:
                self.env[w.name] = None if w.value is None else id
        elif w.kind == "cache" and not inside_try:
            id = self._write(event, None, w.name, w.value, "cache")
            if not w.soft or w.name not in self.cache:
                self.cache[w.name] = id
        else:
            kind = "set" if w.kind == "cache" else w.kind
            scope = opaque[1] if kind == "parent_scope" and len(opaque) > 1 else opaque[0]
            id = self._write(event, scope.id, w.name, w.value, kind)
            if kind == "unset":
                scope.vars.pop(w.name, None)
            else:
                scope.vars[w.name] = id

    def step(self, e) -> int:
        """Takes an event (event_id, file, global_frame, cmd_lower, args; kinds, values, var_refs, env_refs, byte_start and block_end of its node or None; kinds for conditions and set, values for conditions only); gives its scope."""
        self._scopes(e)
        id, cmd, args = e.event_id, e.cmd_lower, list(e.args)
        for name, value in self.seeds:
            self.cache[name] = self._write(id, None, name, value, "cache")
        self.seeds = []
        here = self.stack[-1].id
        kinds = list(e.kinds or ())
        env = set(e.env_refs or ())
        if cmd in E.CONDITIONS:
            raw = list(zip(kinds, e.values or ()))
            env |= {v[4:-1] for k, v in raw if k == "bare" and v.startswith("ENV{") and v.endswith("}") and len(v) > 5 and "$" not in v}
        for name in sorted(env):
            self._emit("read", id, here, name, "env", ref=self.env.get(name), id=self._next("read"))
        for name in e.var_refs or ():
            self._read(id, name, "expand", True)
        if cmd in E.CONDITIONS:
            for name, force in E.conditions(raw):
                self._read(id, name, "condition", force)
        for name in E.list_reads(cmd, args):
            self._read(id, name, "listarg", False)
        for w in E.writes(cmd, args, kinds):
            self._store(id, w)
        if cmd in ("function", "macro") and args:
            self.known[args[0].lower()] = (cmd, args[1:])
            self._emit("def", id, here, args[0], cmd, params=args[1:], id=self._next("def"))
        if "/CMakeScratch/" not in e.file and "/CMakeTmp/" not in e.file:
            for what, target, a, b, c in E.graph(cmd, args):
                self._emit(what, id, here, target, a, b, c, id=self._next(what) if what in self.count else None)
        if cmd == "block":
            end = e.block_end
            span = None if e.byte_start is None or end is None else (e.file, e.byte_start, end)
            no_table = "SCOPE_FOR" in args and "VARIABLES" not in args
            self.stack.append(self._open("block", "", e.global_frame, no_table, id, span))
        self._emit("at", id, here, ref=e.node_id)
        self.opener, self.last = (id, e.global_frame, self._call(cmd, args)), id
        return here

    def finish(self) -> list[tuple]:
        while self.stack:
            self._close(self.last)
        return self.rows


class _Event:
    """An event's columns by name."""

    __slots__ = ("recording", "event_id", "file", "line", "global_frame", "cmd_lower", "args", "node_id", "byte_start", "kinds", "values", "var_refs", "env_refs", "block_end", "seeds")

    def __init__(self, *values):
        (self.recording, self.event_id, self.file, self.line, self.global_frame, self.cmd_lower, self.args, self.node_id, self.byte_start, self.kinds, self.values, self.var_refs, self.env_refs, self.block_end, self.seeds) = values


_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]


def _values(column: pa.Array) -> list:
    """A column's values; those of lists are converted all at once and then cut apart, which is far faster than list by list."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(column.type) and not len(column.flatten()):
        return [[] if there else None for there in column.is_valid().to_pylist()]
    if not pa.types.is_list(column.type) or not pa.types.is_string(column.type.value_type):
        return column.to_pylist() if column.null_count < len(column) else [None] * len(column)
    inner, ends = _values(column.values), column.offsets.to_pylist()
    out = [inner[a:b] for a, b in zip(ends, ends[1:])]
    if column.null_count:
        out = [x if there else None for x, there in zip(out, column.is_valid().to_pylist())]
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Replay | None = None
    event = None

    def frame(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    for b in batches:
        out = []
        for e in map(_Event, *(_values(b.column(c)) for c in _Event.__slots__)):
            if now is None or now.recording != e.recording:
                if now:
                    out += now.finish()
                now, event = Replay(e.recording, [(s["name"], s["value"]) for s in e.seeds or []]), None
            # an event comes once with each command that it may be, the best one first
            if e.event_id == event:
                continue
            event = e.event_id
            now.step(e)
            if now.rows:
                out += now.rows
                now.rows = []
        yield frame(out)
    if now:
        yield frame(now.finish())


def log(events: DataFrame, commands: DataFrame | None = None, nodes: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """The replay's rows. commands and nodes: of the sources, else reads are those without a reference only; seeds: recording, name, value of cache entries given before the first event."""
    session.ship(events.sparkSession)
    return ordered(events, commands, nodes, seeds).mapInArrow(_batches, LOG)


def ordered(events: DataFrame, commands: DataFrame | None = None, nodes: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """The events as the replay takes them, a recording in one task: each with its command, or with each of several of that name on its line, the best one first."""
    e, order = events.select("recording", "event_id", "file", "line", "global_frame", "cmd_lower", "args"), []
    node = "node_id bigint, byte_start bigint, kinds array<string>, values array<string>, var_refs array<string>, env_refs array<string>"
    if commands is None:
        e = e.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in node.split(", "))])
    else:
        # lists that a step doesn't look at aren't carried to it
        asks = F.col("name_lower").isin(*E.CONDITIONS)
        plain = F.transform(F.filter("args", lambda a: (a["kind"] != "bracket") & ~a["value"].contains("$")), lambda a: a["value"])
        c = commands.select(
            "recording", "file", "line", F.col("name_lower").alias("cmd_lower"), "node_id", "byte_start", F.when(asks | (F.col("name_lower") == "set"), F.col("args.kind")).alias("kinds"),
            F.when(asks, F.col("args.value")).alias("values"), "var_refs", "env_refs", plain.alias("plain"))
        # of several commands of a name on a line, the first whose literal arguments all occur among the event's; a row for each, and the replay takes the event's first
        misfit = F.exists("plain", lambda v: ~F.array_contains("args", v))
        e = e.join(c, ["recording", "file", "line", "cmd_lower"], "left").withColumn("misfit", F.coalesce(misfit, F.lit(True))).drop("plain")
        order = ["misfit", "byte_start"]
    if nodes is None:
        e = e.withColumn("block_end", F.lit(None).cast("long"))
    else:
        ends = nodes.where("kind = 'block_def'").select("recording", "file", "byte_start", F.col("byte_end").alias("block_end"))
        e = e.join(ends, ["recording", "file", "byte_start"], "left")
    if seeds is None:
        e = e.withColumn("seeds", F.array().cast("array<struct<name:string,value:string>>"))
    else:
        given = seeds.groupBy("recording").agg(F.collect_list(F.struct("name", "value")).alias("given"))
        e = e.join(given, "recording", "left").withColumn("seeds", F.when(F.col("event_id") == 1, F.col("given"))).drop("given")
    # a replay costs far more than the bytes it reads, so its tasks aren't joined into fewer ones
    one_task = e.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "recording").sortWithinPartitions("recording", "event_id", *order)
    # Spark asks for a batch's size at each row, and a list's vector then goes over all nulls since the last list: with the square of the batch, so lists are empty instead
    lists = [f.name for f in e.schema if f.dataType.typeName() == "array"]
    return one_task.withColumns({x: F.coalesce(x, F.array().cast(e.schema[x].dataType)) for x in lists}).select(*_Event.__slots__)


def tables(events: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The recording's tables from the replay's rows. log should be written or checkpointed first: each table reads it."""
    return steps(events, log) | targets(log)


def _dealt(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A hint holds for what is made from one table, not for what a join gives, so each result has its own."""
    return {name: session.dealt(df) for name, df in tables.items()}


def steps(events: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Events, scopes, variables and definitions; nothing runs for them."""
    of = lambda what: log.where(F.col("what") == what)
    closed = of("close").select("recording", F.col("id").alias("scope_id"), F.col("event_id").alias("closed_by_event"))
    scopes = of("scope").select("recording", "scope_id", F.col("ref").alias("parent_id"), F.col("a").alias("kind"), "name", F.col("flag").alias("transparent"), F.col("event_id").alias("opened_by_event"), F.col("params").alias("chain")).join(closed, ["recording", "scope_id"], "left")
    place = events.select("recording", "event_id", "file", "line")
    return _dealt({
        "events": events.join(of("at").select("recording", "event_id", "scope_id", F.col("ref").alias("node_id")), ["recording", "event_id"], "left"),
        "scopes": scopes.select(*model.columns("scopes")),
        "var_writes": of("write").select("recording", F.col("id").alias("write_id"), "event_id", "scope_id", "name", F.col("a").alias("value"), F.col("b").alias("write_kind")),
        "var_reads": of("read").select("recording", F.col("id").alias("read_id"), "event_id", "scope_id", "name", F.col("ref").alias("resolved_write_id"), F.col("a").alias("read_kind")),
        "func_defs": of("def").join(place, ["recording", "event_id"]).select("recording", F.col("id").alias("def_id"), "event_id", "name", F.lower("name").alias("name_lower"), F.col("a").alias("kind"), "file", "line", "params"),
    })


def targets(log: DataFrame) -> dict[str, DataFrame]:
    """Targets with their links, properties and requirements. Targets and their aliases are written."""
    of = lambda what: log.where(F.col("what") == what)
    null = lambda c: F.when(F.col(c) != "", F.col(c))
    # a name's later definition adds to the first: its type where that has none
    named = session.dealt(session.cut(of("target").groupBy("recording", "name").agg(
        F.min_by(null("a"), F.when(null("a").isNotNull(), F.col("event_id"))).alias("type"), F.max(F.col("c").cast("int")).alias("imported"),
        F.min_by(null("b"), F.when(null("b").isNotNull(), F.col("event_id"))).alias("alias_of"), F.min("event_id").alias("defined_event"), F.lit(0).alias("in_file_api"))))
    real = aliases(named)
    src = real.select("recording", "name", F.col("real").alias("target"))
    dst = real.select("recording", F.col("name").alias("b"), F.col("real").alias("dst_target"))
    edges = of("edge").join(src, ["recording", "name"]).join(dst, ["recording", "b"], "left")
    return _dealt({
        "targets": named,
        "tgt_edges": edges.select("recording", F.col("id").alias("edge_id"), F.col("target").alias("src_target"), F.col("b").alias("dst"), "dst_target", F.col("a").alias("visibility"), F.col("event_id").alias("origin_event")),
        "tgt_props": of("prop").join(src, ["recording", "name"]).select("recording", F.col("id").alias("prop_id"), "target", F.col("a").alias("prop"), F.col("b").alias("value"), F.col("c").cast("int").alias("appended"), F.col("event_id").alias("origin_event")),
        "usage_reqs": of("req").join(src, ["recording", "name"]).select("recording", "target", F.col("c").alias("kind"), F.col("b").alias("value"), F.col("a").alias("visibility"), F.lit("trace").alias("source"), F.col("event_id").alias("origin_event")),
    })


def aliases(targets: DataFrame) -> DataFrame:
    """recording, name, real: the target that a name stands for. The language forbids an alias of an alias; where a damaged trace holds some, each step doubles the hops until none is left, and a ring keeps what it has after as many steps as there could be."""
    real = targets.select("recording", "name", F.coalesce("alias_of", "name").alias("real"))
    link = session.cut(targets.where("alias_of is not null").select("recording", F.col("name").alias("real"), "alias_of"))
    left = link.join(link.select("recording", F.col("real").alias("alias_of")), ["recording", "alias_of"], "left_semi").count()
    for _ in range(left.bit_length()):
        doubled = link.join(link.select("recording", F.col("real").alias("alias_of"), F.col("alias_of").alias("far")), ["recording", "alias_of"], "left")
        link = session.cut(doubled.select("recording", "real", F.coalesce("far", "alias_of").alias("alias_of")))
    return session.dealt(real.join(link.select("recording", F.col("real").alias("name"), "alias_of"), ["recording", "name"], "left").select("recording", "name", F.coalesce("alias_of", "real").alias("real")))
