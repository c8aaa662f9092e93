"""What all rules share: the tables with each event's place and surroundings, and the shape of a finding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import session

RELATED = "array<struct<file:string,line:bigint,note:string>>"


@dataclass
class Config:
    """ignore: by rule, or "" for all, patterns that a whole name must match to be left alone; a rule's own replace those for all. disable: rules that don't run. severity: by rule, another severity."""

    ignore: dict[str, list[str]] = field(default_factory=dict)
    disable: set[str] = field(default_factory=set)
    severity: dict[str, str] = field(default_factory=dict)

    def ignored(self, rule: str, name: Column) -> Column:
        out = F.lit(False)
        for p in self.ignore.get(rule, self.ignore.get("", [])):
            out |= name.rlike(f"^(?:{p})$")
        return out


class Store:
    """A recording's tables by name, as attributes. Tables that were not recorded are None. later: gives more tables, asked once a table is looked for that isn't there."""

    def __init__(self, tables: dict[str, DataFrame], later: Callable[[], dict[str, DataFrame]] | None = None):
        self.__dict__.update(tables)
        self._flags: DataFrame | None = None
        self._later = later

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if self._later:
            more, self._later = self._later, None
            self.__dict__ |= more() | self.__dict__
        return self.__dict__.get(name)

    def flags(self) -> DataFrame:
        """Events with in_source, in_loop (its place in the text is inside foreach or while), in_try, in_callable, scope_kind, scope_name, chain, and kinds, blocks, args_text of their command. Built once and cut off from its lineage, as rules read it several times: its joins in each of their plans fill the driver."""
        if self._flags is None:
            files = self.files.select("recording", F.col("path").alias("file"), "in_source")
            cmd = self.commands.select("recording", "file", "node_id", F.col("args.kind").alias("kinds"), "blocks", "args_text", "var_refs")
            scopes = self.scopes.select("recording", "scope_id", F.col("kind").alias("scope_kind"), F.col("name").alias("scope_name"), "opened_by_event", "chain")
            e = self.events.join(files, ["recording", "file"], "left").join(cmd, ["recording", "file", "node_id"], "left").join(scopes, ["recording", "scope_id"], "left")
            has = lambda *kinds: F.exists("chain", lambda c: F.substring_index(c, ":", -1).isin(*kinds))
            loop = F.exists("blocks", lambda b: b["kind"].isin("foreach_loop", "while_loop"))
            no = lambda c: F.coalesce(c, F.lit(False))
            self._flags = session.dealt(session.cut(e.withColumns({"in_source": F.coalesce("in_source", F.lit(0)) == 1, "in_loop": no(loop), "in_try": no(has("try_compile")), "in_callable": no(has("function", "macro"))})))
        return self._flags

    def at(self, rows: DataFrame, event: str = "event_id", prefix: str = "") -> DataFrame:
        """rows joined with the flags of the event they name; with a prefix, the flags' columns carry it."""
        f = self.flags()
        keep = ["file", "line", "node_id", "cmd_lower", "args", "args_json", "in_source", "in_loop", "in_try", "in_callable", "scope_kind", "scope_name", "opened_by_event", "blocks", "args_text", "kinds"]
        f = f.select("recording", F.col("event_id").alias(event), *[F.col(c).alias(prefix + c) for c in keep])
        return session.dealt(rows.join(f, ["recording", event]))

    def cold(self) -> DataFrame:
        """Commands of the project that no event evaluated."""
        ran = self.events.where("node_id is not null").select("recording", "file", "node_id")
        own = self.files.where("in_source = 1").select("recording", F.col("path").alias("file"))
        return session.dealt(self.commands.join(own, ["recording", "file"], "left_semi").join(ran, ["recording", "file", "node_id"], "left_anti"))

    def static_refs(self) -> DataFrame:
        """recording, name, file, node_id, line: references in the project's text, executed or not; conditions' bare names too."""
        own = self.files.where("in_source = 1").select("recording", F.col("path").alias("file"))
        c = self.commands.join(own, ["recording", "file"], "left_semi")
        word = lambda a: (a["kind"] == "bare") & a["value"].rlike("^[A-Za-z_][A-Za-z0-9_.-]*$")
        bare = F.when(F.col("name_lower").isin("if", "elseif", "while"), F.transform(F.filter("args", word), lambda a: a["value"])).otherwise(F.array().cast("array<string>"))
        return session.dealt(c.select("recording", "file", "node_id", "line", F.explode(F.array_union("var_refs", bare)).alias("name")))

    def names(self, table: str) -> DataFrame:
        return getattr(self, table).select("recording", "name").distinct()


def first(rows: DataFrame, key: list[str], order: str = "event_id") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("recording", *key).orderBy(order))).where("_n = 1").drop("_n")


def text(*parts) -> Column:
    """A message of literals and columns; a missing column is empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def after(args: str | Column, word: str) -> Column:
    """The argument after a word, or null."""
    a = F.col(args) if isinstance(args, str) else args
    p = F.array_position(a, word)
    return F.when(p > 0, F.get(a, p.cast("int")))


def finding(rows: DataFrame, rule: str, severity: str | Column, message: Column, file: str = "file", line: str = "line", related: Column | None = None) -> DataFrame:
    return rows.select(
        "recording", F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(file).alias("file"),
        F.col(line).cast("bigint").alias("line"), message.alias("message"), (F.array() if related is None else related).cast(RELATED).alias("related"))


def sites(rows: DataFrame, key: list[str], most: int, note: str) -> DataFrame:
    """At most that many places of each key, as related places in order; the rest are counted by the caller."""
    n = rows.withColumn("_n", F.row_number().over(W.partitionBy("recording", *key).orderBy("file", "line"))).where(F.col("_n") <= most)
    return n.groupBy("recording", *key).agg(F.array_sort(F.collect_list(F.struct("file", F.col("line").cast("bigint").alias("line"), F.lit(note).alias("note")))).alias("related"))
