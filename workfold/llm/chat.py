"""Chat formatting: layouts recognised by schema fingerprint, mapped to canonical turns, then a template.

A record may be a prompt and a response, an instruction with input and output, a list of messages in
either common spelling, or one row per turn. The nested field paths a record holds are hashed; the hash
selects a declarative mapping. Everything is DataFrame functions; nothing leaves the JVM.

Defined results: NULL texts and roles are empty; turns are ordered by their number, then position, role
and text (so ties and repeated rows have a fixed place; all are kept); a record of no known layout gives
a conversation with no turns and layout 'unknown'; rows without an id form one conversation of their own;
an empty table gives no rows. Other columns are ignored, whatever their names. One conversation is one
output text, so its turns meet in one task; the sort before that spills.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "array<struct<role:string,content:string>>"
SHARED = "array<struct<from:string,value:string>>"
RECORD = ("system string, prompt string, response string, instruction string, input string, output string, "
          f"messages {MESSAGE}, conversations {SHARED}, turn bigint, role string, text string")
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """The paths a record must and may hold, and the turns it stands for: (role, column) pairs, or a list."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None
    row: bool = field(default=False)


LAYOUTS = (
    Layout("turn_row", (), ("turn", "role", "text"), row=True),
    Layout("prompt_response", ("prompt",), ("system", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction",), ("system", "input", "output"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), (("system", ("system",)),), ("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), (("system", ("system",)),), ("conversations", "from", "value")),
)


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def mapping_table(layouts=LAYOUTS) -> dict[str, str]:
    """Fingerprint -> layout, for every set of optional paths a layout allows."""
    table: dict[str, str] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for more in itertools.combinations(layout.optional, n):
                if paths := (*layout.required, *more):
                    table.setdefault(fingerprint(paths), layout.name)
    return table


def _paths(schema: T.StructType) -> dict[str, Column]:
    """Known paths of a frame, with the test whether a row holds them."""
    known = {p for x in LAYOUTS for p in (*x.required, *x.optional)}
    found = {}
    for f in schema.fields:
        if f.name in known:
            found[f.name] = F.col(f.name).isNotNull()
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.fields:
                path = f"{f.name}[].{g.name}"
                if path in known:
                    found[path] = F.exists(F.transform(f.name, lambda m: m[g.name]), lambda v: v.isNotNull())
    return dict(sorted(found.items()))


def parse_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """JSON records of any of the layouts as one wide row; fields a record lacks are NULL."""
    return df.select(F.col(id_col).alias("id"), F.from_json(F.col(json_col).cast("string"), RECORD).alias("r")).select("id", "r.*")


def canonical_turns(df: DataFrame, id_col: str) -> DataFrame:
    """(id, layout, ord, pos, role, text), one row per turn, from a frame that holds known layouts.

    The fingerprint of the row's own paths decides; if it is not known, that of the frame's schema does
    (a turn whose role and text are both NULL still is a turn). A record with no turn has ``pos`` NULL.
    """
    paths = _paths(df.schema)
    table = mapping_table()
    frame = table.get(fingerprint(paths), "unknown")
    own = F.sha2(F.concat_ws("|", *[F.when(held, F.lit(p)) for p, held in paths.items()]), 256)
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    layout = F.coalesce(lookup[own], F.lit(frame))
    kinds = "array<struct<ord:bigint,role:string,text:string>>"

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    chosen = F.array().cast(kinds)
    for x in LAYOUTS:
        if not {*x.required} <= {*paths} or (x.row and not {"role", "text"} & {*paths}):
            continue
        if x.row:
            number = F.col("turn").cast("long") if "turn" in df.columns else F.lit(None).cast("long")
            turns = F.array(F.struct(number.alias("ord"), column("role").alias("role"), column("text").alias("text")))
        else:
            said = [F.when(F.coalesce(*[column(c) for c in cols]).isNotNull(),
                           F.struct(F.lit(0).cast("long").alias("ord"), F.lit(role).alias("role"), F.concat_ws("\n", *[column(c) for c in cols]).alias("text")))
                    for role, cols in x.fields]
            turns = F.filter(F.array(*said), lambda t: t.isNotNull()).cast(kinds)
            if x.listed:
                name, role, text = x.listed
                listed = F.transform(name, lambda m: F.struct(F.lit(0).cast("long").alias("ord"), m[role].alias("role"), m[text].alias("text")))
                turns = F.concat(turns, listed.cast(kinds))
        chosen = F.when(F.col("_layout") == x.name, turns.cast(kinds)).otherwise(chosen)
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    held = df.withColumn("_layout", layout).select(F.col(id_col).alias("id"), F.col("_layout").alias("layout"), F.posexplode_outer(chosen).alias("pos", "t"))
    role = F.coalesce("t.role", F.lit(""))
    return held.select("id", "layout", F.col("t.ord").alias("ord"), "pos",
                       F.when(F.col("layout") == "turn_row", role).otherwise(F.coalesce(names[role], role)).alias("role"),
                       F.coalesce("t.text", F.lit("")).alias("text"))


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the control strings that no text may hold unescaped.

    A control string inside a text gets a backslash after its first character, and one more where
    backslashes stand there already, so the way back is exact for every text.
    """

    opening: str = "<|turn|>"
    closing: str = "</s>"
    controls: tuple[str, ...] = ("<|turn|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def _pattern(self, marked: bool) -> str:
        firsts = "".join(sorted({"\\" + c[0] for c in self.controls}))
        rests = "|".join("".join("\\" + x if not x.isalnum() and x not in "_<>/" else x for x in c[1:]) for c in sorted(set(self.controls)))
        return rf"([{firsts}]){chr(92) * 2 if marked else ''}(\\*)({rests})"

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, self._pattern(False), r"$1\\$2$3")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, self._pattern(True), "$1$2$3")

    def header(self, role: Column) -> Column:
        return self.escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))

    def role_of(self, header: Column) -> Column:
        return F.replace(F.replace(self.unescape(header), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def format_turns(turns: DataFrame, template: Template = Template(), learned: str = "assistant") -> DataFrame:
    """One row per conversation: (id, layout, formatted, loss_spans).

    ``loss_spans`` holds (start, end) in code points, end exclusive, of each learned text as it stands
    in ``formatted``.
    """
    body = template.escape(F.col("text"))
    head = F.concat(F.lit(template.opening), template.header(F.col("role")), F.lit("\n"))
    there = F.col("pos").isNotNull()
    pieces = turns.select(
        "id", "layout", "ord", "pos", "role", "text",
        F.when(there, F.concat(head, body, F.lit(template.closing))).otherwise(F.lit("")).alias("piece"),
        F.length(head).alias("head_chars"), F.length(body).alias("body_chars"))
    order = Window.partitionBy("id").orderBy("ord", "pos", "role", "text")
    placed = pieces.select(
        "id", "layout", "piece", F.row_number().over(order).alias("n"),
        (F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece") + F.col("head_chars")).alias("start"),
        "body_chars", (there & (F.col("role") == learned)).alias("learned"))
    whole = placed.groupBy("id").agg(
        F.min("layout").alias("layout"),
        F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), F.struct(F.col("start"), (F.col("start") + F.col("body_chars")).alias("end"))))).alias("loss_spans"))
    return whole.select("id", "layout", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns and the learned text again, from the formatted text and its spans alone."""
    split = F.split("formatted", "".join("\\" + x if not x.isalnum() else x for x in template.closing))
    parts = F.filter(split, lambda p: p != "")
    turns = F.transform(parts, lambda p: F.struct(
        template.role_of(F.substr(F.substring_index(p, "\n", 1), F.lit(len(template.opening) + 1))).alias("role"),
        template.unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))
    learned = F.transform("loss_spans", lambda s: template.unescape(
        F.substr("formatted", s.start.cast("int") + 1, (s.end - s.start).cast("int"))))
    return formatted.select("id", "layout", "formatted", "loss_spans", turns.alias("turns"), F.array_join(learned, "").alias("learned_text"))
