"""Conversations in reply order, with quotations linked to what they quote and left out.

Messages are often plain text in which lines that begin with ``>`` quote earlier messages,
``> >`` what those quoted, and so on.

1. *Parse.* Each line has a quote level (the number of ``>`` in front, blanks between them
   allowed) and a body. A line like ``On ... wrote:`` right before a quote is no one's words.
2. *Hash.* Bodies are normalised (small letters, runs of white space as one blank, none at
   the ends) and hashed; those that are empty count for nothing. So are the sentences of
   passages: consecutive lines of one level, up to an empty one, joined by a blank. They are
   the same however the lines are wrapped, and where a quote takes a part.
3. *Join.* Quoted lines and sentences are joined by conversation and hash to those that
   earlier messages say themselves. The least level that links decides, by its lines, or
   by its sentences where no line links. The message that holds most of its distinct lines
   (sentences) is the one replied to, of equals the latest. Where nothing links, a message
   replies to the one before it.
4. *Order.* A conversation is its messages in reply order: every message is followed by the
   replies to it, in their order, each with its own replies after it. Quotes are left out.

Defined results: messages with a null conversation or turn belong to none and are left
out; rows repeated whole count once; messages with the same turn are ordered by role and
text. A null text is empty, a null role ``unknown``. A message that only quotes stays, with
an empty text. An empty table gives no conversations. Messages are read whole, whatever
their length; a conversation, however many messages it has, is one row, and must fit in
the memory of a task. Ids keep their type. Extra columns are ignored.

``OP3_SQL`` links by lines of level one alone; it agrees wherever these link, and where
neither sentences nor deeper levels do.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm.common import kind_of

QUOTE = "^[ \\t]*>[ \\t>]*"
WROTE = "^[ \\t]*(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:[ \\t]*$"
SCHEMA = "n_messages int, n_linked int, text string"


def level(line: Column) -> Column:
    """The quote level of a line: 0 where it is the message's own."""
    marks = F.regexp_extract(line, QUOTE, 0)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, QUOTE, "")), "[ \\t\\r]+", " "))


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, role, text) of the messages, numbered from 0 in each conversation."""
    read = conversations.select(
        conversations["conv_id"],
        conversations["turn"].alias("turn"),
        F.coalesce(conversations["role"], F.lit("unknown")).alias("role"),
        F.coalesce(conversations["text"], F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read.where("conv_id is not null and turn is not null").dropDuplicates().withColumn("n", F.row_number().over(order) - 1).select("conv_id", "n", "role", "text")


def lines(texts: DataFrame) -> DataFrame:
    """(conv_id, n, place, level, body, hash) of every line; level -1 marks attributions."""
    split = texts.select("conv_id", "n", F.split("text", "\n").alias("l"))
    each = split.select("conv_id", "n", "l", F.posexplode("l").alias("place", "line"))
    then = F.coalesce(F.try_element_at("l", F.col("place") + 2), F.lit(""))
    kind = F.when((level(F.col("line")) == 0) & F.col("line").rlike(WROTE) & (level(then) > 0), -1).otherwise(level(F.col("line")))
    norm = normalised(F.col("line"))
    return each.select("conv_id", "n", "place", kind.alias("level"), "line", F.when(norm != "", F.xxhash64(norm)).alias("hash"), norm.alias("norm"))


def sentences(texts: DataFrame) -> DataFrame:
    """(conv_id, n, level, hash, norm) of every sentence of the passages."""

    def of(text: str) -> Iterator[tuple[int, str]]:
        split = text.split("\n")
        marks = [m[0] if (m := re.match(QUOTE, line)) else "" for line in split]
        passage: list[str] = []
        for i, (line, mark) in enumerate(zip(split, marks, strict=True)):
            now, then = mark.count(">"), marks[i + 1].count(">") if i + 1 < len(split) else -1
            body = "" if now == 0 and then > 0 and re.match(WROTE, line) else " ".join(line[len(mark) :].lower().split())
            passage += [body] if body else []
            if passage and (not body or then != now):
                for one in re.split(r"(?<=[.!?…])[\"'”»)]* ", " ".join(passage)):
                    if one:
                        yield now, one
                passage = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [(c, n, *x) for c, n, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) for x in set(of(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (part.schema.field(0).type, pa.int32(), pa.int32(), pa.string()), strict=True)], names=["conv_id", "n", "level", "norm"])

    found = texts.select("conv_id", F.col("n").cast("int").alias("n"), "text").mapInArrow(run, f"conv_id {kind_of(texts, 'conv_id')}, n int, level int, norm string")
    return found.withColumn("hash", F.xxhash64("norm"))


def links(parsed: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv_id, n, parent) of the messages that quote an earlier one; of lines and sentences."""
    names = ["conv_id", "n", "level", "kind", "hash", "norm"]
    each = parsed.withColumn("kind", F.lit(0)).select(names).union(passages.withColumn("kind", F.lit(1)).select(names)).where("hash is not null")
    quoted = each.where("level > 0").distinct()
    said = each.where("level = 0").select("conv_id", F.col("n").alias("parent"), "kind", "hash", "norm").distinct()
    hits = quoted.join(said, ["conv_id", "kind", "hash", "norm"]).where("parent < n").groupBy("conv_id", "n", "level", "kind", "parent").agg(F.count("*").alias("hits"))
    best = F.max(F.struct(-F.col("level"), -F.col("kind"), F.col("hits"), F.col("parent").alias("parent")))
    return hits.groupBy("conv_id", "n").agg(best["parent"].alias("parent"))


def own_text(text: Column) -> Column:
    """The text without quotes, attributions and blank lines around."""
    split = F.split(text, "\n")
    keep = F.filter(
        F.transform(split, lambda line, i: F.when((level(line) == 0) & ~(line.rlike(WROTE) & (level(F.coalesce(F.try_element_at(split, i + 2), F.lit(""))) > 0)), line)),
        lambda line: line.isNotNull(),
    )
    return F.regexp_replace(F.array_join(keep, "\n"), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")


def reply_order(parents: list[int]) -> list[int]:
    """Numbers in reply order; a parent is less than its child, -1 stands for none."""
    children: list[list[int]] = [[] for _ in range(len(parents) + 1)]
    for n, p in enumerate(parents):
        children[p].append(n)  # -1 is the last
    out, todo = [], children[-1][::-1]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += children[n][::-1]
    return out


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_messages, n_linked, text): each conversation as one text in reply order.

    ``text`` has ``<|role|>`` and the message, each on lines of their own.
    """
    numbered = messages(conversations)
    quoting = numbered.where(F.col("text").rlike("(?m)" + QUOTE))
    # only conversations in which someone quotes take part in the join
    those = numbered.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    found = links(lines(those), sentences(those))
    linked = numbered.select("conv_id", "n", "role", own_text(F.col("text")).alias("text")).join(found, ["conv_id", "n"], "left")

    whole = linked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "parent"))).alias("m"))

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for m in part.column(1).to_pylist():
                    replies = reply_order([x["n"] - 1 if x["parent"] is None else x["parent"] for x in m])
                    text = "\n".join([f"<|{m[n]['role']}|>\n{m[n]['text']}" for n in replies])
                    out.append((len(m), sum(x["parent"] is not None for x in m), text))
                size, links, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int32()), pa.array(links, pa.int32()), pa.array(text, pa.string())], names=["conv_id", "n_messages", "n_linked", "text"])

    return whole.mapInArrow(order, f"conv_id {kind_of(whole, 'conv_id')}, {SCHEMA}")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text in reply order, without quotes."""
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
with recursive m as (
  select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as n, role, text
  from (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null)
), s as (select conv_id, n, role, string_split(text, chr(10)) as l from m),
e as (select conv_id, n, unnest(range(1, len(l) + 1)) as i, l from s),
f as (select conv_id, n, i, l[i] as line, length(regexp_replace(regexp_extract(l[i], '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) as lv,
  regexp_matches(l[i], '^[ \t]*(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:[ \t]*$') and regexp_matches(coalesce(l[i + 1], ''), '^[ \t]*>') as wrote from e),
p as (select conv_id, n, i, line, case when lv = 0 and wrote then -1 else lv end as lv,
  trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>[ \t>]*', '')), '[ \t\r]+', ' ', 'g')) as norm from f),
h as (select q.conv_id, q.n, o.n as parent, count(*) as hits
  from (select distinct conv_id, n, norm from p where lv = 1 and norm <> '') q
  join (select distinct conv_id, n, norm from p where lv = 0 and norm <> '') o on q.conv_id = o.conv_id and q.norm = o.norm and o.n < q.n group by all),
b as (select conv_id, n, parent from h qualify row_number() over (partition by conv_id, n order by hits desc, parent desc) = 1),
t as (select conv_id, n, regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (where lv = 0), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as text from p group by conv_id, n),
c as (select m.conv_id, m.n, m.role, t.text, b.parent as linked, coalesce(b.parent, m.n - 1) as parent from m join t using (conv_id, n) left join b using (conv_id, n)),
w as (select conv_id, n, [n] as path from c where parent = -1 union all select c.conv_id, c.n, list_append(w.path, c.n) from w join c on c.conv_id = w.conv_id and c.parent = w.n)
select conv_id, count(*)::int as n_messages, count(linked)::int as n_linked, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) order by path) as text
from c join w using (conv_id, n) group by conv_id
"""
