"""Chat formatting: layouts found by schema fingerprint, canonical turns, a reversible template.

The fingerprint of a schema is a digest of its nested field paths, restricted to
the paths that some mapping knows, so that other columns do not matter. It picks
a declarative mapping, which turns a table or a JSON record into canonical turns
(role, text). The template marks turns with control strings; where a text holds
one, a backslash is put after its first character (one more where there are
some already), which reading back undoes.

Defined cases: a null text is empty and a null role is the empty role; turns
sort by turn (null first), then role, then text, and repeated rows are repeated
turns; a null conversation id is a conversation of its own; a JSON record that
is null, malformed or of an unknown layout has no turns; texts and conversations
of any length are formatted whole; an empty table gives an empty table; other
columns come back unchanged, but those with the names of new ones (``turns``,
``formatted``, ``loss_spans`` and what is read back, in any case) are replaced,
and a table of rows by turn keeps its key alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns.

    ``fields``: (role, paths) for layouts with one column a turn; several paths
    are joined by a blank line. ``turns``: the path of a list of turns, with the
    names of its role and text. ``rows``: key, order, role and text columns of a
    table with one row a turn.
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    def paths(self) -> frozenset[str]:
        if self.turns:
            at, role, text = self.turns
            return frozenset({f"{at}[].{role}", f"{at}[].{text}"})
        if self.rows:
            return frozenset(self.rows)
        return frozenset(p for _, ps in self.fields for p in ps)


MAPPINGS = (
    Mapping("rows by turn", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("messages with text", turns=("messages", "role", "text")),
    Mapping("conversations", turns=("conversations", "from", "value")),
    Mapping("dialog", turns=("dialog.turns", "speaker", "utterance")),
    Mapping("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system, prompt and response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction and output", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction, input and output", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)
#: Names of speakers in layouts other than rows by turn.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def digest(paths: frozenset[str] | set[str]) -> str:
    """Fingerprint of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


BY_DIGEST = {digest(m.paths()): m for m in MAPPINGS}
KNOWN = frozenset().union(*(m.paths() for m in MAPPINGS))


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Nested field paths of a Spark type; lists are marked []."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value: object, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")
    else:
        yield at


def mapping_of(paths: set[str]) -> Mapping | None:
    """The mapping whose fingerprint the known paths have; if several layouts are mixed, the largest that fits."""
    own = paths & KNOWN
    if found := BY_DIGEST.get(digest(own)):
        return found
    fits = [m for m in MAPPINGS if m.paths() <= own]
    return max(fits, key=lambda m: (len(m.paths()), m.name), default=None)


def _role(c: Column) -> Column:
    low = F.lower(F.trim(c))
    named = F.coalesce(*[F.when(low == k, v) for k, v in ROLES.items()], low)
    return F.coalesce(named, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical(df: DataFrame, turns: str = "turns") -> DataFrame:
    """A table of any known layout with its turns; raises ValueError for unknown layouts.

    Rows by turn become one row (key, turns) for each conversation; other
    layouts keep their columns.
    """
    m = mapping_of(set(schema_paths(df.schema)))
    if m is None:
        raise ValueError("no mapping has this schema's fingerprint")
    if m.rows:
        key, order, role, text = m.rows
        row = F.struct(F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        listed = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        # array_sort puts null structs last but null fields first, as documented above.
        return listed.select(key, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias(turns))
    if m.turns:
        at, role, text = m.turns
        made = F.transform(F.coalesce(F.col(at), F.array()), lambda t: _turn(_role(t[role]), t[text]))
    else:
        made = F.array(*[_turn(F.lit(r), F.concat_ws("\n\n", *[F.when(F.col(p) != "", F.col(p)) for p in ps])) for r, ps in m.fields])
    return df.withColumn(turns, made)


def _get(record: dict, path: str) -> object:
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def record_turns(record: object) -> list[tuple[str, str]]:
    """Canonical turns of one JSON record."""
    if not isinstance(record, dict):
        return []
    m = mapping_of(set(value_paths(record)))
    say = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    name = lambda v: ROLES.get(say(v).strip().lower(), say(v).strip().lower())
    if m is None or m.rows:
        return []
    if m.turns:
        at, role, text = m.turns
        return [(name(t.get(role)), say(t.get(text))) for t in _get(record, at) or [] if isinstance(t, dict)]
    return [(r, "\n\n".join(v for p in ps if (v := say(_get(record, p))))) for r, ps in m.fields]


def canonical_json(df: DataFrame, column: str, turns: str = "turns") -> DataFrame:
    """Adds the turns of JSON records, whose layouts may differ from row to row."""

    def one(text: str | None) -> list[dict]:
        try:
            found = record_turns(json.loads(text)) if text else []
        except ValueError:
            found = []
        return [{"role": r, "text": t} for r, t in found]

    return add_columns(df, column, [T.StructField(turns, TURNS)], lambda rows: [[one(r) for r in rows]])


# The control strings of the template.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<ROLE:|</ROLE>>)"
USER = ("<s>[INST] ", " [/INST]")
ASSISTANT = (" ", " </s>")
READ = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<ROLE:(?P<role>.*?)>> (?P<text>.*?) <</ROLE>>| (?P<assistant>.*?) </s>", re.S)
UNESCAPE = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|<ROLE:|</ROLE>>)")


def escape(text: Column) -> Column:
    """text with a backslash inside each control string."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the code-point ranges of what assistants say in it."""

    def part(t: Column) -> Column:
        plain = t["role"].rlike("^[A-Za-z0-9_.-]*$")
        label = F.concat(F.lit("<<ROLE:"), F.when(plain, t["role"]).otherwise(F.concat(F.lit("="), F.hex(t["role"]))), F.lit(">> "))
        by = lambda user, assistant, other: F.when(t["role"] == "user", user).when(t["role"] == "assistant", assistant).otherwise(other)
        return F.struct(
            by(F.lit(USER[0]), F.lit(ASSISTANT[0]), label).alias("head"),
            escape(t["text"]).alias("body"),
            by(F.lit(USER[1]), F.lit(ASSISTANT[1]), F.lit(" <</ROLE>>")).alias("tail"),
            (t["role"] == "assistant").alias("loss"),
        )

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        lo = acc["at"] + F.length(p["head"])
        hi = lo + F.length(p["body"])
        span = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        return F.struct((hi + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    own = fresh("parts", df.columns)
    parts = df.withColumn(own, F.transform(turns, part))
    return parts.withColumn("formatted", F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")).withColumn("loss_spans", F.aggregate(own, start, step, lambda acc: acc["spans"])).drop(own)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds; raises ValueError if it isn't one."""
    found, at = [], 0
    for m in READ.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        at = m.end()
        if m["user"] is not None:
            found.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            found.append(("assistant", unescape(m["assistant"])))
        else:
            role = m["role"]
            found.append((bytes.fromhex(role[1:]).decode() if role.startswith("=") else role, unescape(m["text"])))
    if at != len(text):
        raise ValueError(f"not a turn at {at}")
    return found


FIELDS = [
    T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()),
]


def read_back(df: DataFrame, output: str = "output") -> DataFrame:
    """Adds digests read from a column of structs (formatted, loss_spans)."""

    def one(row: dict) -> tuple:
        text = row["formatted"]
        turns = read_turns(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss_spans"])
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)

    def make(rows: list) -> list[list]:
        return [list(c) for c in zip(*map(one, rows), strict=True)] if rows else [[] for _ in FIELDS]

    return add_columns(df, output, FIELDS, make)
