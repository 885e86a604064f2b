"""Chat formatting with schema fingerprints, in DataFrame operations only.

Records come in several layouts. The layout of a record is the set of its nested field paths (``messages[].role``); a hash of the
sorted paths, taken row by row, selects a declarative mapping to canonical turns, ``array<struct<role, text>>``. Of a typed column (records of many layouts, read
into one type) a row's paths are those that are not null in it, in an array in any of its elements; of a JSON column they are its keys, in an array those of
any element. Records without a mapping, and malformed JSON, have null turns.

A conversation is written as ``<|role|>text<|end|>`` for each turn. A backslash is put into control strings inside roles and texts (after
``<`` of ``<|``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, after ``[`` of ``[INST]``, ``[/INST]``, after the bar of ``|>``) and doubled where the text has one itself, so no control string is left
in a text and the way back is exact. The loss mask is an array of spans (start, end) of code points of the formatted text, one for each assistant text.

Both ways, turns are rows: places are running sums over the turns of a conversation, and pieces meet the mask in one order by place, so the
time is that of a sort, in proportion to the text.

Defined cases: null texts and roles are empty; null turn numbers come first, equal ones are ordered by role, then text; repeated rows are turns of their
own; a null ``conv_id`` is a conversation; a conversation without turns is the empty text; an empty table gives only what the query adds; columns
of other names are not read. One conversation is one output row and meets in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import table

ASSISTANT = "assistant"
END = "<|end|>"
TURNS = "array<struct<role: string, text: string>>"
# Control strings of common chat templates, as a Java pattern of the characters after which a backslash goes.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>)"

#: Records of all layouts in one type.
RECORD = "struct<messages: array<struct<turn: bigint, role: string, content: string, text: string>>, conversations: array<struct<from: string, value: string>>, prompt: string, response: string, completion: string, instruction: string, input: string, output: string, system: string>"

# Layouts: the field paths, and the SQL of the turns of a record ``r``.
LAYOUTS = {
    ("messages[].role", "messages[].text", "messages[].turn"): "transform(array_sort(r.messages), m -> named_struct('role', m.role, 'text', m.text))",
    ("messages[].content", "messages[].role"): "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))",
    ("conversations[].from", "conversations[].value"): "transform(r.conversations, m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'text', m.value))",
    ("prompt", "response"): "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.response))",
    ("completion", "prompt"): "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.completion))",
    ("input", "instruction", "output"): "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))), named_struct('role', 'assistant', 'text', r.output))",
    ("instruction", "output"): "array(named_struct('role', 'user', 'text', r.instruction), named_struct('role', 'assistant', 'text', r.output))",
    ("prompt", "response", "system"): "array(named_struct('role', 'system', 'text', r.system), named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.response))",
}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): turns for paths, turns in LAYOUTS.items()}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; an array adds ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def present_paths(kind: T.DataType, value: str, at: str = "") -> list[tuple[str, str]]:
    """Nested field paths of a type, each with SQL that tells whether ``value`` has it."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in present_paths(f.dataType, f"{value}.`{f.name}`", f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        element = f"e{at.count('[]')}"
        return [(path, f"coalesce(exists({value}, {element} -> {there}), false)") for path, there in present_paths(kind.elementType, element, at + "[]")]
    return [(at, f"{value} IS NOT NULL")]


def typed_turns(df: DataFrame, column: str) -> Column:
    """Canonical turns of a struct column whose rows may have different layouts, by the fingerprint of each row."""
    kind = df.schema[column].dataType
    paths = sorted(present_paths(kind, f"`{column}`"))
    there = ", ".join(f"if({sql}, '{path}', null)" for path, sql in paths)
    mark = f"substring(sha2(array_join(array({there}), '\n'), 256), 1, 16)"
    own = {path for path, _ in paths}
    cases = [f"when '{fingerprint(layout)}' then transform(array(`{column}`), r -> cast({turns} as {TURNS}))[0]" for layout, turns in LAYOUTS.items() if set(layout) <= own]
    return F.expr(f"case {mark} {' '.join(cases)} end") if cases else F.lit(None).cast(TURNS)


def json_turns(column: str) -> Column:
    """Canonical turns of a JSON column whose rows may have different layouts. A row's paths are its top-level keys, and for an array of objects
    the keys of all its elements."""
    at = lambda more: f"get_json_object({column}, concat('$[', chr(39), k, chr(39), ']{more}'))"
    keys = f"coalesce(json_object_keys({column}), cast(array() as array<string>))"
    none = "cast(array() as array<string>)"
    # a text that looks like an array has no first element
    elements = f"if({at('[0]')} is null, {none}, coalesce(from_json({at('')}, 'array<string>'), {none}))"
    inner = f"array_distinct(flatten(transform({elements}, e -> coalesce(json_object_keys(e), {none}))))"
    paths = f"array_sort(flatten(transform({keys}, k -> if(size({inner}) = 0, array(k), transform({inner}, j -> k || '[].' || j)))))"
    mark = f"substring(sha2(array_join({paths}, '\n'), 256), 1, 16)"
    cases = " ".join(f"when '{k}' then transform(array(from_json({column}, '{RECORD}')), r -> cast({v} as {TURNS}))[0]" for k, v in MAPPINGS.items())
    return F.expr(f"case {mark} {cases} end")


def escaped(text: str) -> str:
    """SQL for a text with its control strings broken."""
    return rf"regexp_replace(replace(coalesce({text}, ''), '\\', '\\\\'), r'{CONTROL}', r'$0\\')"


def unescaped(text: str) -> str:
    return rf"regexp_replace({text}, r'(?s)\\(.)', '$1')"


def formatted(df: DataFrame, key: str, turns: str = "turns") -> DataFrame:
    """``(key, formatted, loss_mask)`` of ``df``, whose ``key`` is unique; ``turns`` names canonical turns."""
    rows = df.select(key, F.posexplode_outer(turns).alias("at", "t"))
    rows = rows.select(key, "at", F.expr(f"'<|' || {escaped('t.role')} || '|>'").alias("open"), F.expr(escaped("t.text")).alias("body"), (F.coalesce("t.role", F.lit("")) == ASSISTANT).alias("loss"))
    rows = rows.withColumns({"a": F.char_length("open"), "b": F.char_length("body")})
    before = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("a") + F.col("b") + len(END)).over(before), F.lit(0)) + F.col("a")
    rows = rows.withColumn("start", F.when(F.col("at").isNotNull(), start).cast("int"))
    piece = F.when(F.col("at").isNotNull(), F.struct("at", F.concat("open", "body", F.lit(END)).alias("piece")))
    span = F.when(F.col("at").isNotNull() & F.col("loss"), F.struct(F.col("start"), (F.col("start") + F.col("b")).alias("end")))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("p"), F.array_sort(F.collect_list(span)).alias("loss_mask"))
    return found.select(key, F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"), "loss_mask")


def read_back(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """``df(key, formatted, loss_mask)`` with ``read_turns``, parsed from the formatted text alone, and ``loss_text``, what lies under the mask, unescaped. Pieces
    end at the end mark; a mask span is the piece whose text starts and ends where the span does."""
    none = "cast(null as int)"
    row = lambda kind, at, start, end, body: f"named_struct('kind', {kind}, 'at', {at}, 'start', {start}, 'end', {end}, 'body', {body})"
    cut = r"split(formatted, r'<\|end\|>', -1)"
    pieces = f"transform(slice({cut}, 1, greatest(size({cut}) - 1, 0)), (c, i) -> {row(2, 'i', none, none, 'c')})"
    spans = f"transform(loss_mask, (s, i) -> {row(1, 'i', 's.start', 's.end', 'cast(null as string)')})"
    whole = f"array({row(0, '0', none, none, 'formatted')})"
    rows = df.select(key, F.explode(F.expr(f"concat({whole}, {spans}, {pieces})")).alias("r")).select(key, "r.*")
    own, length = F.col("kind") == 2, F.char_length("body")
    before = W.partitionBy(key).orderBy("kind", "at").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.when(own, length + len(END)).otherwise(0)).over(before), F.lit(0)).cast("int")
    rows = rows.withColumns({"ahead": ahead, "role": F.when(own, F.expr("substring_index(substring(body, 3), '|>', 1)"))})
    rows = rows.withColumn("start", F.when(own, F.col("ahead") + F.char_length("role") + 4).otherwise(F.col("start")))
    rows = rows.withColumn("end", F.when(own, F.col("ahead") + length).otherwise(F.col("end")))
    order = W.partitionBy(key).orderBy("start", "kind")
    last = lambda c: F.lag(c).over(order)
    rows = rows.withColumn("loss", own & (last("kind") == 1) & (last("start") == F.col("start")) & (last("end") == F.col("end")))
    rows = rows.withColumns({"text": F.when(own, F.expr(unescaped("substring(body, char_length(role) + 5)"))), "role": F.expr(unescaped("role"))})
    turn = F.when(own, F.struct("at", "role", "text"))
    mask = F.when(F.col("kind") == 1, F.struct("start", "end"))
    under = F.when(F.col("loss"), F.struct("at", "text"))
    found = rows.groupBy(key).agg(F.max(F.when(F.col("kind") == 0, F.col("body"))).alias("formatted"), F.array_sort(F.collect_list(mask)).alias("loss_mask"), F.array_sort(F.collect_list(turn)).alias("t"), F.array_sort(F.collect_list(under)).alias("u"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return found.select(key, "formatted", "loss_mask", turns.alias("read_turns"), F.array_join(F.transform("u", lambda u: u["text"]), "").alias("loss_text"))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """``(conv_id, record)``: flat rows ``(conv_id, turn, role, text)`` as records of mixed layouts. A question and its answer, with or without a system
    text, are a prompt and a response; of the others a third each are ``conversations`` of ``from`` and ``value`` (if no role is called as that layout calls the
    speakers), ``messages`` of role and content, and ``messages`` with turn numbers, by a hash of the id."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    roles = "transform(m, x -> x.role)"
    pick = "pmod(xxhash64(conv_id), 3)"
    layout = f"""case when {roles} = array('user', 'assistant') then 0 when {roles} = array('system', 'user', 'assistant') then 1
        when {pick} = 0 and not arrays_overlap({roles}, array('human', 'gpt')) then 2 when {pick} = 1 then 3 else 4 end"""
    told = told.withColumn("l", F.expr(layout))
    message = "named_struct('turn', {turn}, 'role', x.role, 'content', {content}, 'text', {text})"
    typed = message.format(turn="x.turn", content="cast(null as string)", text="x.text")
    plain = message.format(turn="cast(null as bigint)", content="x.text", text="cast(null as string)")
    said = "named_struct('from', case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end, 'value', x.text)"
    fields = {
        "messages": f"case l when 3 then transform(m, x -> {plain}) when 4 then transform(m, x -> {typed}) end",
        "conversations": f"case l when 2 then transform(m, x -> {said}) end",
        "system": "case l when 1 then m[0].text end",
        "prompt": "case l when 0 then m[0].text when 1 then m[1].text end",
        "response": "case l when 0 then m[1].text when 1 then m[2].text end",
    }
    parts = ", ".join(f"'{name}', {fields.get(name, 'null')}" for name in ("messages", "conversations", "prompt", "response", "completion", "instruction", "input", "output", "system"))
    return told.select("conv_id", F.expr(f"cast(named_struct({parts}) as {RECORD})").alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    records = conversations_as_records(rows)
    return formatted(records.select("conv_id", typed_turns(records, "record").alias("turns")), "conv_id")


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_conversations(rows.unionByName(probe)))
    turns = "array_join(transform(read_turns, t -> t.role || '\\n' || t.text || '\\n'), '')"
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.expr(f"sha2({turns}, 256)").alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The digests follow from the rows, so SQL can state them; ``formatted_chars`` from the template's rule.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS r1,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t1 FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(replace(r1, '|>', '|\>')) + length(replace(t1, '|>', '|\>')) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
