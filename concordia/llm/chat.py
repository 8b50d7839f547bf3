"""Chat formatting by schema fingerprints.

The layout of a table or of a JSON record is known by a hash over its nested field paths. The hash picks a declarative mapping (a few SQL
expressions) that brings the layout to canonical turns: (conv_id, turn, role, text). Turns are then written in one template, in which
control strings inside texts are escaped, and every turn comes with its span under the loss mask.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from pyspark.sql.window import Window

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes of a JSON record. A turn by itself may be as long as a string can be.
LONGEST_RECORD = 1 << 27


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths that make the layout, [] for array elements. turns: an SQL expression for
    array<struct<role string, text string>> of one record, or None where a row is one turn by itself."""

    name: str
    paths: tuple[str, ...]
    turns: str | None
    json: str | None = None  # the same over JSON_SCHEMA, where that differs

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_IS_LIST = "startswith(schema_of_variant(m.content), 'ARRAY')"
_PARTS = "try_cast(m.content as array<struct<text string>>)"
#: A list of parts is the texts of its parts.
_MESSAGES = f"transform(messages, m -> struct(m.role as role, if({_IS_LIST}, array_join({_PARTS}.text, ''), try_variant_get(m.content, '$', 'string')) as text))"
_PAIR = "filter(array({}), x -> x.text is not null)"
LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), None),
    Layout("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), "transform(messages, m -> struct(m.role as role, m.content as text))", _MESSAGES),
    Layout("messages of parts", ("messages", "messages[]", "messages[].content", "messages[].content[]", "messages[].content[].text", "messages[].role"), "transform(messages, m -> struct(m.role as role, array_join(m.content.text, '') as text))", _MESSAGES),
    Layout("conversations", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), "transform(conversations, m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))"),
    Layout("instruction", ("instruction", "output"), _PAIR.format("struct('user' as role, instruction as text), struct('assistant' as role, output as text)")),
    Layout("instruction with input", ("input", "instruction", "output"), _PAIR.format("struct('user' as role, concat_ws('\\n\\n', instruction, nullif(input, '')) as text), struct('assistant' as role, output as text)")),
    Layout("instruction with system", ("instruction", "output", "system"), _PAIR.format("struct('system' as role, system as text), struct('user' as role, instruction as text), struct('assistant' as role, output as text)")),
    Layout("instruction with system and input", ("input", "instruction", "output", "system"), _PAIR.format("struct('system' as role, system as text), struct('user' as role, concat_ws('\\n\\n', instruction, nullif(input, '')) as text), struct('assistant' as role, output as text)")),
    Layout("prompt", ("completion", "prompt"), _PAIR.format("struct('user' as role, prompt as text), struct('assistant' as role, completion as text)")),
    Layout("prompt with system", ("completion", "prompt", "system"), _PAIR.format("struct('system' as role, system as text), struct('user' as role, prompt as text), struct('assistant' as role, completion as text)")),
)
BY_FINGERPRINT = {x.fingerprint: x for x in LAYOUTS}
KNOWN = frozenset(p for x in LAYOUTS for p in x.paths)


def schema_paths(schema: DataType, prefix: str = "") -> list[str]:
    if isinstance(schema, StructType):
        return [q for f in schema.fields for p in [f"{prefix}.{f.name}".lstrip(".")] for q in [p, *schema_paths(f.dataType, p)]]
    if isinstance(schema, ArrayType):
        return [f"{prefix}[]", *schema_paths(schema.elementType, f"{prefix}[]")]
    return []


def layout_of(schema: StructType) -> Layout:
    """The layout that a table's field paths hash to; paths that no layout has are left out first."""
    found = BY_FINGERPRINT.get(fingerprint(p for p in schema_paths(schema) if p in KNOWN))
    if found is None:
        raise ValueError(f"no layout for the field paths {schema_paths(schema)}")
    return found


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout; one record is one conversation, named by conv_id."""
    found = layout_of(df.schema)
    if found.turns is None:
        return df.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    out = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(F.expr(found.turns)).alias("turn", "t"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


#: All fields of the layouts in one schema to parse JSON records by; a message's content may be a text or a list of parts.
JSON_SCHEMA = "messages array<struct<role string, content variant>>, conversations array<struct<`from` string, value string>>, " + ", ".join(f"{f} string" for f in ("instruction", "input", "output", "system", "prompt", "completion"))


def json_paths() -> str:
    """SQL for the known field paths that a parsed record has, as an array; what is null is absent."""
    has = lambda array, field, path: f"if(exists({array}, m -> m.`{field}` is not null), '{path}', null)"
    paths = [f"if({f} is not null, '{f}', null)" for f in ("instruction", "input", "output", "system", "prompt", "completion")]
    for array, fields in (("messages", ("role", "content")), ("conversations", ("from", "value"))):
        paths += [f"if({array} is not null, '{array}', null)", f"if(size({array}) > 0, '{array}[]', null)", *(has(array, f, f"{array}[].{f}") for f in fields)]
    parts = f"if(exists(messages, m -> {_IS_LIST}), '{{}}', null)"
    return f"array({', '.join(paths + [parts.format(p) for p in ('messages[].content[]', 'messages[].content[].text')])})"


def json_turns(df: DataFrame, raw_col: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records in mixed layouts. A record's own field paths, less those that no layout has, hash to its mapping. Records of
    no known layout, null ones and what isn't JSON give one row with turn, role, text and layout null, so that none goes unnoticed; so does a list of no messages, with its
    layout. Repeated records and ids of any type, null ones too, are taken as they are; other columns are ignored. A record of more than LONGEST_RECORD bytes is an error."""
    options = {"maxStringLen": str(2**31 - 1)}
    raw = F.col(raw_col).cast("string")
    # a variant holds 128 MiB: beyond that a message would be lost without a word
    raw = F.when(F.octet_length(raw) > LONGEST_RECORD, F.raise_error(F.lit(f"a record of more than {LONGEST_RECORD} bytes: pass its turns as rows"))).otherwise(raw)
    out = df.select(F.col(conv_id).alias("_conv"), F.from_json(raw, JSON_SCHEMA, options).alias("r")).select("_conv", "r.*")
    known = f"substr(sha2(array_join(array_sort(filter({json_paths()}, p -> p is not null)), '\n'), 256), 1, 16)"
    out = out.withColumn("_print", F.expr(known))
    named = [x for x in LAYOUTS if x.turns]
    turns = F.expr("case _print " + " ".join(f"when '{x.fingerprint}' then {x.json or x.turns}" for x in named) + " end")
    layout = F.expr("case _print " + " ".join(f"when '{x.fingerprint}' then '{x.name}'" for x in named) + " end")
    out = out.select(F.col("_conv").alias("conv_id"), layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout")


def escape(text: Column) -> Column:
    """No control string is left: \\ becomes \\\\, and <| becomes <\\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans): one row a conversation of canonical turns.

    spans has for each turn in order: start (its first code point in formatted), loss_start and loss_end (what of it is
    under the loss mask; equal if nothing is). Null text or role: empty. Turns go by turn (null first), then role, then text, so that
    repeated rows and ties have one order. A null conv_id is one conversation. Empty tables give no rows. A
    conversation is one value of the result, and so is held by one task; nothing else is."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), F.concat(escape(text), F.lit(END + "\n")).alias("tail"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = (F.length("head") + F.length("tail")).cast("long")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.select("conv_id", F.row_number().over(order).alias("n"), "role", "head", "tail", (end - size).alias("start"))
    first = F.col("start") + F.length("head")
    last = F.when(F.col("role") == loss_role, first + F.length("tail") - len(END) - 1).otherwise(first)
    piece = F.struct("n", F.concat("head", "tail").alias("piece"), F.struct("start", first.alias("loss_start"), last.alias("loss_end")).alias("span"))
    out = out.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return out.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), F.col("p.span").alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array<struct<role, text>>) and loss_text to the rows of format_chat, from formatted and spans alone."""
    out = formatted.withColumn("_parts", F.split("formatted", r"<\|im_start\|>", -1))
    out = out.withColumn("_parts", F.transform(F.slice("_parts", F.lit(2), F.size("_parts") - 1), lambda s: F.concat(F.lit(START), s)))
    head = r"(?s)\A<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"

    def turn(s):
        role = F.regexp_extract(s, head, 1)
        rest = F.substr(s, F.length(role) + len(START) + 2)
        return F.struct(unescape(role).alias("role"), unescape(F.left(rest, F.length(rest) - len(END) - 1)).alias("text"))

    masked = F.zip_with("_parts", "spans", lambda s, x: F.substr(s, (x["loss_start"] - x["start"] + 1).cast("int"), (x["loss_end"] - x["loss_start"]).cast("int")))
    return out.withColumn("turns", F.transform("_parts", turn)).withColumn("loss_text", F.array_join(F.transform(masked, unescape), "")).drop("_parts")


def probe_conversation(spark: SparkSession) -> DataFrame:
    says = f"{END}{START}assistant ok"
    return spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{says}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")


def through_layouts(turns: DataFrame) -> DataFrame:
    """Turn rows, of which two thirds of the conversations come as JSON records of two layouts with a field that no layout has: one record a turn, which keeps its place."""
    role, text, third = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.pmod(F.xxhash64("conv_id"), F.lit(3))
    # names that the layout gives another meaning stay as rows, and so do texts that could be too long for a record once they are escaped
    plain = third.isin(0) | (third.isin(2) & role.isin("human", "gpt")) | (F.octet_length(text) + F.octet_length(role) > LONGEST_RECORD >> 4)
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    messages = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"), F.lit("x").alias("name"))).alias("messages")))
    conversations = F.to_json(F.struct(F.lit("x").alias("id"), F.array(F.struct(speaker.alias("from"), text.alias("value"))).alias("conversations")))
    records = turns.where(~plain).select(F.struct("conv_id", "turn").alias("conv_id"), F.when(third == 1, messages).otherwise(conversations).alias("record"))
    read = json_turns(records).select("conv_id.conv_id", "conv_id.turn", "role", "text")
    return canonical_turns(turns.where(plain)).unionByName(read)


def op2_chat(spark, sf_dir):
    """Whole conversations, as rows and as records of two layouts; the result is what it is from rows alone."""
    turns = through_layouts(table(spark, sf_dir, "conversations"))
    out = read_back(format_chat(turns.unionByName(probe_conversation(spark))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) AS er FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
