"""Chat exports of two kinds as conversations and messages.

Export files are read whole as binary, one per row, because an export may be a
zip; their JSON lands as VARIANT, as its content is a union of strings, objects
and lists. From there on everything is DataFrame expressions over the exploded
top-level array; only unzipping is Python.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scratch

BASENAME = "conversations.json"
#: Paths of export files in a folder.
NAMES = r"(/conversations\.json|\.zip)$"
#: Where a conversation's copy stands; an export may hold several of one id.
COPY = ("path", "position")
#: Nodes of a tree whose path is found within its row.
IN_PLACE = 256

_NODE = "struct<id:string,parent:string,children:array<string>,message:variant>"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, texts = [], []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path.lower().endswith(".zip"):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next((n for n in z.namelist() if n.rsplit("/", 1)[-1] == BASENAME), None)
                        content = z.read(name) if name else None
                except zipfile.BadZipFile:
                    content = None
            if content is not None:
                paths.append(path)
                texts.append(content.decode("utf-8-sig", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])


def read_exports(spark: SparkSession, path: str, names: str = NAMES) -> DataFrame:
    """path, position, conversation (VARIANT): the elements of each export's top-level list.

    ``path`` is a .json or .zip file, or a folder that is searched for files
    whose lower-case path matches ``names``. Files that aren't JSON or whose
    top level isn't a list give no row.
    """
    reader = spark.read.format("binaryFile")
    files = reader.load(path) if path.lower().endswith((".json", ".zip")) else reader.option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(names))
    texts = files.select("path", "content").mapInArrow(_unpacked, "path string, text string")
    parsed = texts.select("path", F.try_parse_json("text").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'ARRAY<%'")
    parsed.createOrReplaceTempView("_exports")
    return spark.sql("SELECT path, e.pos AS position, e.value AS conversation FROM _exports, LATERAL variant_explode(v) AS e")


def text_at(v: Column | str, path: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "string")


def parse_timestamp(value: Column) -> Column:
    """POSIX seconds of seconds, milliseconds or an ISO time; null where it is none of them."""
    number = F.expr("try_cast(NULL AS double)") if value is None else value.try_cast("double")
    iso = F.regexp_replace(F.regexp_replace(value, r"(\.\d{6})\d+", "$1"), "Z$", "+00:00")
    seconds = F.try_to_timestamp(iso)
    return F.coalesce(F.when(number > 1e12, number / 1000).otherwise(number), seconds.cast("double"))


def looks_like_tree(conversation: str = "conversation") -> Column:
    """Export with a message tree: mapping, and title or create_time."""
    has = lambda p: F.try_variant_get(conversation, p, "variant").isNotNull()
    return has("$.mapping") & (has("$.title") | has("$.create_time"))


def looks_like_list(conversation: str = "conversation") -> Column:
    """Export with a message list: chat_messages and uuid."""
    has = lambda p: F.try_variant_get(conversation, p, "variant").isNotNull()
    return has("$.chat_messages") & has("$.uuid")


def _variants(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def flatten_parts(content: Column) -> Column:
    """Text of a message's content: parts by blank lines, assets named, code fenced."""
    kind = F.try_variant_get(content, "$.content_type", "string")
    is_object = F.schema_of_variant
    one = lambda p: F.coalesce(
        F.when(is_object(p) == "STRING", F.try_variant_get(p, "$", "string")),
        F.try_variant_get(p, "$.text", "string"),
        F.concat(F.lit("[asset:"), F.coalesce(F.try_variant_get(p, "$.content_type", "string"), F.lit("asset")), F.lit("]")),
    )
    parts = F.array_join(F.filter(F.transform(_variants(content, "$.parts"), one), lambda x: F.trim(x) != ""), "\n\n")
    text = F.coalesce(F.try_variant_get(content, "$.text", "string"), F.lit(""))
    code = F.concat(F.lit("```"), F.coalesce(F.try_variant_get(content, "$.language", "string"), F.lit("")), F.lit("\n"), text, F.lit("\n```"))
    return F.when(kind == "code", code).when(_variants(content, "$.parts").isNotNull(), parts).otherwise(text)


def linearised(nodes: DataFrame, in_place: int = IN_PLACE) -> DataFrame:
    """key, step, message: the path from root to the current node, or down last children.

    ``nodes`` has key (of a conversation), current, mapping (id -> node). The
    path of a tree of up to ``in_place`` nodes is an aggregate within its row.
    That takes time by the square of its depth, so larger trees are exploded
    and their pointers squared, in as many rounds as the depth has bits.
    """
    small = _folded(nodes.where(F.size("mapping") <= in_place))
    each = nodes.where(F.size("mapping") > in_place).select("key", "current", F.posexplode("mapping").alias("at", "id", "node"))
    large = scratch.table(each.select("key", "current", "at", "id", "node.parent", "node.children", "node.message"), "nodes")
    return small if large.isEmpty() else small.unionByName(_doubled(large))


def _folded(nodes: DataFrame) -> DataFrame:
    """Paths of small trees."""
    m = F.col("mapping")
    ids = F.map_keys(m)
    node = lambda i: F.try_element_at(m, i)
    steps = F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)))
    # upwards: parents of the current node, each once
    up = F.aggregate(steps, F.array(F.col("current")), lambda path, _: F.when(node(F.element_at(path, -1))["parent"].isNotNull() & ~F.array_contains(path, F.coalesce(node(F.element_at(path, -1))["parent"], F.lit(""))) & F.array_contains(ids, F.coalesce(node(F.element_at(path, -1))["parent"], F.lit(""))), F.concat(path, F.array(node(F.element_at(path, -1))["parent"]))).otherwise(path))
    root = F.get(F.filter(ids, lambda i: node(i)["parent"].isNull() | ~F.array_contains(ids, F.coalesce(node(i)["parent"], F.lit("")))), F.lit(0))
    last_child = lambda i: F.try_element_at(F.filter(F.coalesce(node(i)["children"], F.array().cast("array<string>")), lambda c: F.array_contains(ids, c)), F.lit(-1))
    down = F.aggregate(steps, F.array(root), lambda path, _: F.when(last_child(F.element_at(path, -1)).isNotNull() & ~F.array_contains(path, F.coalesce(last_child(F.element_at(path, -1)), F.lit(""))), F.concat(path, F.array(last_child(F.element_at(path, -1))))).otherwise(path))
    has_current = F.col("current").isNotNull() & F.array_contains(ids, F.coalesce("current", F.lit("")))
    path = F.when(has_current, F.reverse(up)).otherwise(down)
    return nodes.select("key", "mapping", F.posexplode(path).alias("step", "id")).select("key", "step", F.try_element_at("mapping", "id")["message"].alias("message"))


def _doubled(nodes: DataFrame) -> DataFrame:
    """Paths of large trees; ``nodes`` has key, current, at (place in the mapping), id, parent, children, message.

    Each node points on, to its parent or to its last child. Marks begin at
    the path's first node; in a round what is marked marks what its pointer
    of 1, 2, 4, ... steps reaches, and pointers are squared. A node that is
    met again ends the path, so a loop does too.
    """
    ids = nodes.select("key", "id")
    real = lambda df, c: df.join(ids.withColumnRenamed("id", c), ["key", c], "left_semi")
    upward = nodes.where("current IS NOT NULL").select("key", F.col("current").alias("id")).distinct().join(ids, ["key", "id"], "left_semi")
    known = scratch.table(upward.select("key", F.lit(True).alias("up")), "upward")
    parents = real(nodes.select("key", "id", "at", "parent"), "parent").select("key", "id", F.col("parent").alias("to"))
    children = real(nodes.select("key", "id", F.posexplode("children").alias("place", "child")), "child").groupBy("key", "id").agg(F.max_by("child", "place").alias("to"))
    roots = nodes.join(parents.select("key", "id"), ["key", "id"], "left_anti").groupBy("key").agg(F.min_by("id", "at").alias("id"))
    jumps = scratch.table(parents.join(known, "key", "left_semi").unionByName(children.join(known, "key", "left_anti")), "jumps")
    marks = scratch.table(upward.unionByName(roots.join(known, "key", "left_anti").select("key", "id")).withColumn("step", F.lit(0)), "marks")
    length = 1
    while True:
        reached = marks.join(jumps, ["key", "id"]).groupBy("key", F.col("to").alias("id")).agg((F.min("step") + length).alias("step"))
        fresh = scratch.table(reached.join(marks.select("key", "id"), ["key", "id"], "left_anti"), "marks")
        if fresh.isEmpty():
            break
        marks = scratch.table(marks.unionByName(fresh), "marks")
        onward = jumps.select("key", F.col("id").alias("to"), F.col("to").alias("further"))
        jumps = scratch.table(jumps.join(onward, ["key", "to"]).select("key", "id", F.col("further").alias("to")), "jumps")
        length *= 2
    ends = marks.join(known, "key").groupBy("key").agg(F.max("step").alias("last"))
    ordered = marks.join(ends, "key", "left").select("key", "id", F.coalesce(F.col("last") - F.col("step"), F.col("step")).alias("step"))
    return ordered.join(nodes.select("key", "id", "message"), ["key", "id"]).select("key", "step", "message")


ROLES = ("user", "assistant", "system", "tool")


def tree_messages(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages of tree exports."""
    rows = exports.where(looks_like_tree())
    key = F.coalesce(text_at("conversation", "$.id"), text_at("conversation", "$.conversation_id"), F.concat("path", F.lit("#"), F.col("position").cast("string")))
    conversations = rows.select(
        *COPY, key.alias("source_conversation_id"), F.lit("chatgpt").alias("source"), F.coalesce(text_at("conversation", "$.title"), F.lit("Untitled")).alias("title"),
        parse_timestamp(text_at("conversation", "$.create_time")).alias("created_at"), parse_timestamp(text_at("conversation", "$.update_time")).alias("updated_at"),
    )
    nodes = rows.select(F.struct(*COPY).alias("key"), text_at("conversation", "$.current_node").alias("current"), F.try_variant_get("conversation", "$.mapping", f"map<string,{_NODE}>").alias("mapping"))
    path = linearised(nodes).where("message IS NOT NULL AND schema_of_variant(message) <> 'VOID'")
    role = F.lower(F.coalesce(text_at("message", "$.author.role"), F.lit("other")))
    said = path.select(
        "key", "step", F.when(role.isin(*ROLES), role).otherwise("other").alias("role"), flatten_parts(F.try_variant_get("message", "$.content", "variant")).alias("content_text"),
        parse_timestamp(text_at("message", "$.create_time")).alias("timestamp"), text_at("message", "$.id").alias("source_message_id"),
    ).where("NOT (role IN ('system', 'tool') AND trim(coalesce(content_text, '')) = '')")
    ordinal = F.row_number().over(Window.partitionBy("key").orderBy("step")) - 1
    return conversations, said.withColumn("ordinal", ordinal).select("key.*", "ordinal", "role", "content_text", "timestamp", "source_message_id")


def flatten_blocks(message: Column) -> Column:
    """Text of a message with typed blocks, its attachments and files named."""
    get = lambda v, p: F.try_variant_get(v, p, "string")
    inner = lambda b: F.coalesce(
        F.array_join(F.filter(F.transform(_variants(b, "$.content"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull()), "\n"), get(b, "$.content"), F.lit("")
    )
    block = lambda b: (
        F.when(get(b, "$.type") == "text", F.coalesce(get(b, "$.text"), F.lit("")))
        .when(get(b, "$.type") == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(get(b, "$.name"), F.lit("tool")), F.lit("]")))
        .when(get(b, "$.type") == "tool_result", F.concat(F.lit("[tool_result] "), inner(b)))
        .otherwise(F.coalesce(get(b, "$.text"), F.lit("")))
    )
    named = lambda path, mark: F.transform(F.coalesce(_variants(message, path), F.array().cast("array<variant>")), lambda x: F.concat(F.lit(f"[{mark}:"), F.coalesce(get(x, "$.file_name"), get(x, "$.name"), F.lit("file")), F.lit("]")))
    body = F.filter(F.transform(F.coalesce(_variants(message, "$.content"), F.array().cast("array<variant>")), block), lambda x: F.trim(x) != "")
    text = F.when(F.size(body) > 0, body).otherwise(F.array_compact(F.array(F.nullif(F.coalesce(get(message, "$.text"), F.lit("")), F.lit("")))))
    return F.array_join(F.concat(text, named("$.attachments", "attachment"), named("$.files", "file")), "\n\n")


def sender_role(sender: Column) -> Column:
    s = F.lower(F.coalesce(sender, F.lit("")))
    return F.when(s.isin("human", "user"), "user").when(s.isin("assistant", "claude"), "assistant").when(s == "system", "system").otherwise("other")


def list_messages(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages of list exports; blank messages leave gaps in the ordinals."""
    rows = exports.where(looks_like_list())
    key = text_at("conversation", "$.uuid")
    conversations = rows.select(
        *COPY, key.alias("source_conversation_id"), F.lit("claude").alias("source"), F.coalesce(F.nullif(text_at("conversation", "$.name"), F.lit("")), F.lit("Untitled")).alias("title"),
        parse_timestamp(text_at("conversation", "$.created_at")).alias("created_at"), parse_timestamp(text_at("conversation", "$.updated_at")).alias("updated_at"),
    )
    each = rows.select(F.struct(*COPY).alias("key"), F.posexplode(_variants(F.col("conversation"), "$.chat_messages")).alias("step", "m"))
    at = parse_timestamp(text_at("m", "$.created_at"))
    said = each.select("key", "step", at.alias("timestamp"), sender_role(text_at("m", "$.sender")).alias("role"), flatten_blocks(F.col("m")).alias("content_text"), text_at("m", "$.uuid").alias("source_message_id"))
    ordinal = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("timestamp", F.lit(0.0)), "step")) - 1
    numbered = said.withColumn("ordinal", ordinal).where("trim(content_text) <> ''")
    return conversations, numbered.select("key.*", "ordinal", "role", "content_text", "timestamp", "source_message_id")


#: Parsers by name; each takes the rows of ``read_exports`` that it recognises.
PARSERS = {"chatgpt": tree_messages, "claude": list_messages}


def parse_exports(exports: DataFrame, parser: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Every copy of a conversation, and its messages, by the named parser or by all that recognise a row.

    Both have path and position, which tell copies of one conversation_id
    apart; messages are numbered within their copy.
    """
    if parser != "auto" and parser not in PARSERS:
        raise KeyError(f"no parser {parser!r}; there are {', '.join(PARSERS)}")
    if parser == "auto":  # a row that both recognise is the first's
        conversations, messages = tree_messages(exports)
        others = list_messages(exports.where(~F.coalesce(looks_like_tree(), F.lit(False))))
        conversations, messages = conversations.unionByName(others[0]), messages.unionByName(others[1])
    else:
        conversations, messages = PARSERS[parser](exports)
    conversations = conversations.withColumn("conversation_id", derived_id("conv_", "source", "source_conversation_id"))
    messages = messages.join(conversations.select(*COPY, "source", "source_conversation_id", "conversation_id"), list(COPY))
    return conversations, messages.drop("source").withColumn("message_id", derived_id("msg_", "conversation_id", F.col("ordinal").cast("string")))


def derived_id(prefix: str, *parts: Column | str) -> Column:
    """An id that is the same in every run: a prefix and 16 hex digits of the parts' hash."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))
