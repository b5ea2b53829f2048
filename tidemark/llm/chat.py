"""Chat formatting: records of different layouts become canonical turns, then one marked-up text with a loss mask.

Each record is a JSON text. Its nested field paths, without types and values, form its shape; the hash of the shape picks a
declarative mapping (``LAYOUTS``). A record whose shape is unknown (extra or missing optional fields) takes the first layout
whose fields it has; if there is none, or the JSON is broken, ``layout`` is null and there are no turns. Strings and nesting may
be of any length; a record that is too large for a variant (128 MiB) fails with an error, and so does a broken one of ``JUDGED``
bytes or more, which cannot be told from it. Rows by turn become one record each, whatever the size of their conversation. DataFrame
operations only.

The template is ``<|turn|>role<|text|>text<|end|>\\n`` per turn. Texts and roles are escaped: backslashes are doubled and a
backslash parts the first character of each control string from its rest, so no text can hold a mark and ``unescape``
gives back every text. Null roles and texts are empty. Turns are ordered by number (null first), ties by role and text, so
repeated rows stay. Rows with a null ``conv_id`` form one conversation. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Openings that models take for control strings. The first covers the marks of the template.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_TURNS = "array<struct<role string, text string>>"
_SPANS = "array<struct<start long, length long>>"
#: No limits of the JSON reader but that of the variant. A variant has at most 8 bytes a byte of JSON, so shorter
#: records that give no variant are broken.
_LIMITLESS = {"maxStringLen": "2147483647", "maxNestingDepth": "2147483647", "maxNumLen": "2147483647", "allowSingleQuotes": "false"}
JUDGED = (128 << 20) // 8

#: name, shape, and what makes the turns: a list field with (path, role field, text field), or one (role, paths joined by an
#: empty line) per turn. Shapes list fields in alphabetical order, as nested paths.
LAYOUTS = [
    ("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", ("$.messages", "role", "content")),
    ("message_list", "ARRAY<OBJECT<content, role>>", ("$", "role", "content")),
    ("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", ("$.conversations", "from", "value")),
    ("system_prompt_response", "OBJECT<prompt, response, system>", [("system", ["$.system"]), ("user", ["$.prompt"]), ("assistant", ["$.response"])]),
    ("prompt_response", "OBJECT<prompt, response>", [("user", ["$.prompt"]), ("assistant", ["$.response"])]),
    ("prompt_completion", "OBJECT<completion, prompt>", [("user", ["$.prompt"]), ("assistant", ["$.completion"])]),
    ("question_answer", "OBJECT<answer, question>", [("user", ["$.question"]), ("assistant", ["$.answer"])]),
    ("instruction_input_output", "OBJECT<input, instruction, output>", [("user", ["$.instruction", "$.input"]), ("assistant", ["$.output"])]),
    ("instruction_output", "OBJECT<instruction, output>", [("user", ["$.instruction"]), ("assistant", ["$.output"])]),
]
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape(value: Column) -> Column:
    """The nested field paths of a variant: its schema without the types of the leaves."""
    return F.regexp_replace(F.schema_of_variant(value), r": (?!ARRAY|OBJECT)[A-Z][^,<>]*", "")


def fingerprint(value: Column) -> Column:
    return F.xxhash64(shape(value))


def _turns(value: Column, how) -> tuple[Column, Column]:
    """(turns, whether all fields are there)."""
    if isinstance(how, tuple):
        path, role, text = how
        rows = F.try_variant_get(value, path, f"array<struct<`{role}` string, `{text}` string>>")
        name = lambda r: F.coalesce(*(F.when(r == k, F.lit(v)) for k, v in ROLES.items()), r) if role == "from" else r
        turns = F.transform(rows, lambda x: F.struct(name(x[role]).alias("role"), x[text].alias("text")))
        return turns, rows.isNotNull() & ((F.size(rows) == 0) | F.exists(rows, lambda x: x[role].isNotNull() | x[text].isNotNull()))
    get = lambda p: F.try_variant_get(value, p, "string")
    turns = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when((get(p) != "") | F.lit(i == 0), get(p)) for i, p in enumerate(paths))).alias("text")) for role, paths in how))
    there = get(how[0][1][0]).isNotNull()
    for _, paths in how[1:]:
        there = there & get(paths[0]).isNotNull()
    return turns, there


def _value(record: Column) -> Column:
    """The variant of a JSON text; null if it is null or broken, an error if it is too large."""
    large = F.concat(F.lit("record of "), F.octet_length(record).cast("string"), F.lit(" bytes is beyond the size of a variant, or broken"))
    return F.coalesce(F.try_parse_json(record), F.from_json(record, "variant", _LIMITLESS), F.when(F.octet_length(record) >= JUDGED, F.raise_error(large)))


def canonical(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with ``layout_`` and ``turns_`` (array of role, text)."""
    d = records.withColumn("value_", _value(F.col(json_col))).withColumn("print_", fingerprint(F.col("value_")))
    made = [(name, F.xxhash64(F.lit(s)), *_turns(F.col("value_"), how)) for name, s, how in LAYOUTS]
    exact = F.coalesce(*(F.when((F.col("print_") == h) & there, F.lit(name)) for name, h, _, there in made))
    near = F.coalesce(*(F.when(there, F.lit(name)) for name, _, _, there in made))
    d = d.withColumn("layout_", F.coalesce(exact, near))
    pick = F.coalesce(*(F.when(F.col("layout_") == name, t.cast(_TURNS)) for name, _, t, _ in made), F.array().cast(_TURNS))
    return d.withColumn("turns_", pick).drop("value_", "print_")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: DataFrame) -> DataFrame:
    """With ``formatted_`` and ``mask_``: (start, length) in code points of each assistant text within it."""
    safe = F.transform("turns_", lambda t: F.struct(escape(F.coalesce(t["role"], F.lit(""))).alias("role"), escape(F.coalesce(t["text"], F.lit(""))).alias("text"), (t["role"] == "assistant").alias("learn")))
    d = turns.withColumn("safe_", safe)
    d = d.withColumn("formatted_", F.array_join(F.transform("safe_", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), ""))
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + len(TURN) + F.char_length(t["role"]) + len(TEXT)
        n = F.char_length(t["text"]).cast("long")
        spans = F.when(F.coalesce(t["learn"], F.lit(False)), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), n.alias("length"))))).otherwise(acc["spans"])
        return F.struct((start + n + len(END)).alias("pos"), spans.alias("spans"))

    def append(acc: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct((s["start"] + acc["pos"]).alias("start"), s["length"].alias("length")))
        return F.struct((acc["pos"] + block["pos"]).alias("pos"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    # spans within each block of turns first, then the blocks one after the other
    d = d.withColumn("blocks_", F.transform(_blocks("safe_"), lambda b: F.aggregate(b, zero, step)))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{_SPANS}>").alias("spans"))
    return d.withColumn("mask_", F.flatten(F.aggregate("blocks_", start, append, lambda acc: acc["spans"]))).drop("safe_", "blocks_")


def _blocks(items: str) -> Column:
    """An array cut into about as many blocks as a block has items: work that is quadratic in a block or in the number of blocks
    stays below linear times the square root."""
    n = F.size(items)
    k = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    return F.transform(F.filter(F.sequence(F.lit(0), F.ceil(n / k).cast("int")), lambda b: b * k < n), lambda b: F.slice(items, b * k + 1, k))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def learnt(formatted: str, mask: str) -> Column:
    """All text under the loss mask (columns by name), unescaped, in order. The stretch that a block of spans covers is cut out
    first, so no span is searched from the start of a long text."""
    first, last = lambda b: F.get(b, F.lit(0))["start"], lambda b: F.element_at(b, -1)
    stretch = lambda b: F.substring(formatted, (first(b) + 1).cast("int"), (last(b)["start"] + last(b)["length"] - first(b)).cast("int"))
    cut = F.transform(_blocks(mask), lambda b: F.struct(stretch(b).alias("text"), first(b).alias("at"), b.alias("spans")))
    said = lambda c: F.transform(c["spans"], lambda s: unescape(F.substring(c["text"], (s["start"] - c["at"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(F.transform(cut, lambda c: F.array_join(said(c), "")), "")


def _said(rows: DataFrame) -> DataFrame:
    """(conv_id, messages): the turns of each conversation in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("content"))))
    g = rows.groupBy("conv_id").agg(turns.alias("m"))
    return g.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def records_of(rows: DataFrame) -> DataFrame:
    """Rows by turn as records (conv_id, record) of the ``messages`` layout."""
    return _said(rows).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


def turns_of(rows: DataFrame) -> DataFrame:
    """Rows by turn as (conv_id, layout_, turns_): each row is a record of one message, which its layout maps to turns like any other
    record; the turns of a conversation are put in order afterwards, so a conversation may be of any size."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    message = F.struct(text("role").alias("role"), text("text").alias("content"))
    d = canonical(rows.select("conv_id", "turn", F.to_json(F.struct(F.array(message).alias("messages"))).alias("record")))
    mapped = F.when(F.col("layout_").isNotNull(), F.col("turns_")).otherwise(F.raise_error(F.lit("rows by turn have no layout")).cast(_TURNS))
    d = d.select("conv_id", "turn", "layout_", F.inline(mapped))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("text"))))
    g = d.groupBy("conv_id").agg(F.max("layout_").alias("layout_"), said.alias("said_"))
    return g.select("conv_id", "layout_", F.transform("said_", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(_TURNS).alias("turns_"))


def probe_rows(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns that consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    pair = F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))
    return spark.range(1).select(F.inline(pair))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: digests of the turns and of the learnt text, both read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe_rows(spark))
    d = render(turns_of(rows))
    d = d.withColumn("read_", read_back(F.col("formatted_"))).withColumn("learnt_", learnt("formatted_", "mask_"))
    said = F.array_join(F.transform("read_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("read_").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                    F.char_length("learnt_").cast("long").alias("loss_chars"), F.sha2(F.col("learnt_").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted_").cast("long").alias("formatted_chars"))


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""
