"""Quotation linking in conversations, with DataFrame functions only.

Lines that begin with > are quotes; their nested levels are parsed, quoted passages hashed and joined to the messages
that said the same: as their whole text, a paragraph, or any run of lines. That message is what the quoting one replies
to. Following replies from the first message on gives the conversations without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.store import drop_table, materialize, read_table

NO_KEY = -(1 << 63)  # stands for null in keys
SPACE = r"[ \t\n\x0B\f\r]+"
MARKS = r"^(?:[ \t]*>)+"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def parsed_lines(text: Column) -> Column:
    """The lines of a text: level (0: not quoted) and content behind the marks."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return let(marks, lambda m: F.struct((F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))).alias("level"), F.substr(x, F.length(m) + 1).alias("content")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line)


def spoken(contents: Column) -> Column:
    """The normalised lines that say anything."""
    return F.filter(F.transform(contents, normalized), lambda x: x != "")


def quoted_passages(lines: Column) -> Column:
    """level, text (normalised) and lines (normalised, those that say anything) of each run of quoted lines of one level
    that says anything."""

    def runs(ls: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(0), F.size(ls)), lambda i: (i == 0) | (i == F.size(ls)) | (F.get(ls, i - 1)["level"] != F.get(ls, i)["level"]))

        def between(bs: Column) -> Column:
            def run(k: Column) -> Column:
                start = F.get(bs, k)
                own = F.slice(ls, start + 1, F.get(bs, k + 1) - start)
                said = F.transform(own, lambda x: x["content"])
                return F.struct(F.get(ls, start)["level"].alias("level"), normalized(F.array_join(said, "\n")).alias("text"), spoken(said).alias("lines"))

            return F.transform(F.sequence(F.lit(0), F.size(bs) - 2), run)

        return let(changes, between)

    return F.filter(let(lines, runs), lambda p: (p["level"] > 0) & (p["text"] != ""))


def unquoted(text: Column, lines: Column) -> Column:
    """The text without quoted lines; as it is if it has none."""
    own = F.filter(lines, lambda x: x["level"] == 0)
    rest = F.trim(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), F.lit(" \t\n\r"))
    return F.when(F.size(own) == F.size(lines), F.coalesce(text, F.lit(""))).otherwise(rest)


def running_sum(rows: DataFrame, key: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over a key's rows up to each row.

    bucket must rise with the order; a bucket's rows are summed by themselves and the sums of the buckets before are
    added, so a key of very many rows is spread over its buckets.
    """
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(key, bucket).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = F.sum("_value").over(Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_local", local).join(sums, [key, bucket]).withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_value", "_local", "_before")


def doubled_runs(lines: Column) -> Column:
    """Hashes of an array's runs of 1, 2, 4, ... elements: the k-th array has those of 2^k, by first element."""

    def longer(levels: Column, k: Column) -> Column:
        last, half = F.get(levels, F.size(levels) - 1), F.pow(F.lit(2), k).cast("int")
        n = F.greatest(F.size(last) - half, F.lit(0))
        pairs = F.transform(F.slice(last, 1, n), lambda h, i: F.xxhash64(h, F.get(last, i + half)))
        return F.array_append(levels, pairs)

    first = F.array(F.transform(lines, lambda x: F.xxhash64(x)))
    steps = F.floor(F.log2(F.greatest(F.size(lines), F.lit(1)).cast("double"))).cast("int")
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), first, longer)).otherwise(first)


def run_hashes(levels: Column, n_lines: Column, size: Column) -> Column:
    """Hashes of all runs of `size` lines, from doubled_runs: of its first and last 2^k lines, which cover the run."""
    k = F.floor(F.log2(size.cast("double"))).cast("int")
    return let(F.get(levels, k), lambda own: F.transform(F.slice(own, 1, F.greatest(n_lines - size + 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(own, i + size - F.pow(F.lit(2), k).cast("int")))))


def depths(branches: DataFrame) -> DataFrame:
    """conv, branch, depth_before: how many messages the replies before a branch's first message run through.

    branches: conv, branch, parent_branch (null: none), steps (from the parent branch's first message to the branch's).
    Branches point to their parents' parents' in each round, so a chain of branches takes a logarithm of rounds.
    """
    state = materialize(branches.select("conv", "branch", F.col("parent_branch").alias("up"), F.when(F.col("parent_branch").isNull(), 0).otherwise(F.col("steps")).cast("long").alias("depth_before")), "chat-branches")
    while not state.filter("up is not null").isEmpty():
        above = state.select("conv", F.col("branch").alias("up"), F.col("up").alias("next"), F.col("depth_before").alias("more"))
        joined = state.join(above, ["conv", "up"], "left").select("conv", "branch", F.col("next").alias("up"), (F.col("depth_before") + F.coalesce("more", F.lit(0))).alias("depth_before"))
        now = materialize(joined, "chat-branches")
        drop_table(state)
        state = now
    return state.select("conv", "branch", "depth_before")


def link_quotations(messages: DataFrame, bucket_turns: int = 256) -> DataFrame:
    """A row for each message (conv_id, turn, role, text; other columns are ignored).

    conv_id, turn, role; position: its place in the conversation, from 1, by turn, then role, then text (nulls first);
    parent_position: the message that it replies to, null for the first; branch: from 1, a new one wherever a message
    answers another than the one right before it; parent_branch: that of its parent; depth: its place, from 1, in the
    conversation that following replies from the first message to it gives; n_quotes: its quoted passages; n_linked:
    those found in an earlier message of the conversation; max_level: of its quoted lines; body: its text without
    quotes; formatted: body between role markers. Parents come before replies, so position is a reply order, and rows
    of a branch follow one another; reply_conversations() lays out what leads to each branch.

    A quoted passage is found in a message whose body says the same (white space and case apart) as a whole, in a
    paragraph, or in a run of lines, empty ones apart. A message replies to the first message that said what it quotes;
    of several quotes those of the lowest level count, and of these the latest message. If it quotes nothing that is
    found, it replies to the message before it. Quotes of later messages don't count. A null text is empty, a null role
    an empty one, null conv_ids are one conversation. Repeated rows each have a place. Empty tables give an empty result.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_KEY)).alias("conv"),
        F.floor(F.coalesce(F.col("turn"), F.lit(NO_KEY)) / bucket_turns).alias("bucket"),
    )
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    placed = running_sum(rows, "conv", "bucket", order, F.lit(1), "position")
    parsed = placed.withColumn("lines", parsed_lines(F.col("text")))
    parsed = parsed.withColumn("passages", quoted_passages(F.col("lines"))).withColumn("body", unquoted(F.col("text"), F.col("lines")))
    parsed = parsed.withColumn("max_level", F.array_max(F.transform("lines", lambda x: x["level"]))).drop("lines", "text")
    parsed = materialize(parsed, "chat-parsed")

    quotes = parsed.filter(F.size("passages") > 0).select("conv", "position", F.posexplode("passages").alias("no", "p"))
    quotes = quotes.select("conv", "position", "no", F.col("p.level").alias("level"), F.sha2("p.text", 256).alias("hash"), F.col("p.lines").alias("lines"))
    # only conversations that quote anything need their messages looked up
    quoting = quotes.select("conv").distinct()
    asked = parsed.join(quoting, "conv", "left_semi").select("conv", "position", "body")
    said = F.array_distinct(F.transform(F.concat(F.array("body"), F.split("body", r"\n[ \t\r]*\n")), normalized))
    whole = asked.select("conv", "position", F.explode(F.filter(said, lambda x: x != "")).alias("said")).select("conv", "position", F.sha2("said", 256).alias("hash"))
    # runs of lines: of as many lines as any passage of the conversation has
    sizes = quotes.groupBy("conv").agg(F.collect_set(F.size("lines")).alias("sizes"))  # bounded by the longest message
    lines = asked.select("conv", "position", spoken(F.split("body", "\n")).alias("lines")).filter(F.size("lines") > 0)
    lines = lines.select("conv", "position", F.size("lines").alias("n"), doubled_runs(F.col("lines")).alias("levels")).join(sizes, "conv")
    runs = lines.select("conv", "position", "n", "levels", F.explode(F.filter("sizes", lambda x: x <= F.col("n"))).alias("size"))
    runs = runs.select("conv", "position", "size", F.explode(F.array_distinct(run_hashes(F.col("levels"), F.col("n"), F.col("size")))).alias("run"))
    runs = runs.select("conv", "position", F.concat_ws(":", "size", "run").alias("hash"))
    originals = whole.unionByName(runs).groupBy("conv", "hash").agg(F.min("position").alias("original"))
    n = F.size("lines")
    own = F.get(run_hashes(doubled_runs(F.col("lines")), n, n), 0)
    keys = quotes.select("conv", "position", "no", "level", F.explode(F.array("hash", F.concat_ws(":", n, own))).alias("hash"))
    linked = keys.join(originals, ["conv", "hash"]).filter("original < position")
    linked = linked.groupBy("conv", "position", "no").agg(F.min("level").alias("level"), F.min("original").alias("original"))
    replies = linked.groupBy("conv", "position").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.struct(-F.col("level"), "original"))["original"].alias("original"))

    # replies, branches and depths are worked out on positions alone; the bodies are joined to them once
    places = parsed.select("conv", "bucket", "position").join(replies, ["conv", "position"], "left")
    places = places.withColumn("parent_position", F.coalesce("original", F.when(F.col("position") > 1, F.col("position") - 1)))
    jumps = F.when((F.col("position") == 1) | (F.col("parent_position") != F.col("position") - 1), 1).otherwise(0)
    places = materialize(running_sum(places, "conv", "bucket", ["position"], jumps, "branch").withColumn("jumps", jumps).select("conv", "position", "parent_position", "branch", "jumps", "n_linked"), "chat-places")
    # a conversation whose messages all answer the one before has one branch, from its first message on
    starts = places.filter("jumps = 1").select("conv", "branch", F.col("position").alias("start"), "parent_position")
    parents = starts.filter("parent_position is not null").select("conv", "branch", "start", F.col("parent_position").alias("position"))
    parents = parents.join(places.select("conv", "position", F.col("branch").alias("parent_branch")), ["conv", "position"])
    parents = parents.join(starts.select("conv", F.col("branch").alias("parent_branch"), F.col("start").alias("parent_start")), ["conv", "parent_branch"])
    tree = parents.select("conv", "branch", "start", "parent_branch", (F.col("position") - F.col("parent_start") + 1).alias("steps"))
    tree = materialize(tree.unionByName(starts.filter("parent_position is null").select("conv", "branch", "start", F.lit(None).cast("long").alias("parent_branch"), F.lit(0).cast("long").alias("steps"))), "chat-tree")
    tree = tree.join(depths(tree), ["conv", "branch"])
    # rows of one long branch are not gathered by its key: first branches, which all conversations have, need no join
    later = tree.filter("branch > 1").select("conv", "branch", "start", "parent_branch", "depth_before")
    placed = places.filter("branch > 1").join(later, ["conv", "branch"]).withColumn("depth", F.col("depth_before") + F.col("position") - F.col("start") + 1)
    columns = ["conv", "position", "parent_position", "branch", "parent_branch", "depth", "n_linked"]
    placed = placed.select(*columns).unionByName(places.filter("branch = 1").withColumns({"parent_branch": F.lit(None).cast("long"), "depth": F.col("position")}).select(*columns))
    out = parsed.join(placed, ["conv", "position"])
    role = F.coalesce("role", F.lit(""))
    return out.select(
        "conv_id", "turn", "role", "position", "parent_position", "branch", "parent_branch", "depth", F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("max_level").cast("long").alias("max_level"), "body", F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.col("body"), F.lit("<|im_end|>\n")).alias("formatted"),
    )


def reply_conversations(linked: DataFrame) -> DataFrame:
    """conv_id, branch, place, position, role, body: for each branch of link_quotations() the messages that lead to it along
    replies, and its own, by place from 1. A branch's rows are one conversation without quotes.

    A message is there once for each branch that is reached through it. Rows, not lists: a conversation has no bound.
    """
    rows = linked.withColumn("conv", F.coalesce("conv_id", F.lit(NO_KEY)))
    rows = materialize(rows.select("conv", "conv_id", "branch", "parent_branch", "parent_position", "position", "depth", "role", "body"), "chat-linked")
    starts = rows.filter("position = 1 or parent_position <> position - 1").select("conv", "branch", "parent_branch", "parent_position")
    now = materialize(starts.select("conv", "branch", F.col("branch").alias("through"), F.lit(None).cast("long").alias("upto")), "chat-paths")
    paths = [now]
    up = starts.filter("parent_branch is not null").select("conv", F.col("branch").alias("through"), F.col("parent_branch").alias("next"), F.col("parent_position").alias("upto"))
    while not (now := materialize(now.drop("upto").join(up, ["conv", "through"]).select("conv", "branch", F.col("next").alias("through"), "upto"), "chat-paths")).isEmpty():
        paths.append(now)  # a round for each level of branches
    every = paths[0]
    for more in paths[1:]:
        every = every.unionByName(more)
    own = rows.select("conv", "conv_id", F.col("branch").alias("through"), F.col("depth").alias("place"), "position", "role", "body")
    return every.join(own, ["conv", "through"]).filter("upto is null or position <= upto").select("conv_id", "branch", "place", "position", "role", "body")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of conversations, linked and formatted."""
    return link_quotations(read_table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
  FROM conversations
), l AS (
  SELECT conv_id, position, line, i, regexp_extract(line, '^(?:[ \t]*>)+') AS marks
  FROM (SELECT conv_id, position, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM m)
), c AS (
  SELECT conv_id, position, i, length(marks) - length(replace(marks, '>', '')) AS level, substr(line, length(marks) + 1) AS content FROM l
), r AS (
  SELECT *, i - row_number() OVER (PARTITION BY conv_id, position, level ORDER BY i) AS run FROM c
), p AS (
  SELECT conv_id, position, level, run, lower(trim(regexp_replace(string_agg(content, chr(10) ORDER BY i), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS said,
         list_filter(list(lower(trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g'))) ORDER BY i), lambda x: x <> '') AS lines
  FROM r WHERE level > 0 GROUP BY conv_id, position, level, run
), b AS (
  SELECT conv_id, position, max(level) AS max_level,
         CASE WHEN max(level) > 0 THEN trim(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), chr(32) || chr(9) || chr(10) || chr(13))
              ELSE string_agg(content, chr(10) ORDER BY i) END AS body
  FROM c GROUP BY conv_id, position
), o AS (
  SELECT conv_id, position, lower(trim(regexp_replace(unnest(list_concat([body], regexp_split_to_array(body, '\n[ \t\r]*\n'))), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS said FROM b
), w AS (
  SELECT conv_id, position, list_filter(list_transform(string_split(body, chr(10)), lambda x: lower(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')))), lambda x: x <> '') AS lines FROM b
), f AS (
  SELECT p.conv_id, p.position, p.level, p.run, min(o.position) AS original FROM p JOIN o ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.said = o.said AND o.position < p.position
  WHERE p.said <> '' GROUP BY ALL
  UNION ALL
  SELECT p.conv_id, p.position, p.level, p.run, min(w.position) AS original FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND w.position < p.position
   AND len(list_filter(generate_series(1, len(w.lines) - len(p.lines) + 1), lambda i: w.lines[i:i + len(p.lines) - 1] = p.lines)) > 0
  WHERE p.said <> '' GROUP BY ALL
), k AS (
  SELECT conv_id, position, count(*) AS n_linked, arg_max(original, (-level, original)) AS original
  FROM (SELECT conv_id, position, level, run, min(original) AS original FROM f GROUP BY ALL) GROUP BY conv_id, position
), q AS (
  SELECT conv_id, position, count(*) AS n_quotes FROM p WHERE said <> '' GROUP BY conv_id, position
), j AS (
  SELECT m.conv_id, m.turn, m.role, m.position, coalesce(k.original, CASE WHEN m.position > 1 THEN m.position - 1 END) AS parent_position,
         coalesce(q.n_quotes, 0) AS n_quotes, coalesce(k.n_linked, 0) AS n_linked, b.max_level, b.body
  FROM m JOIN b ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.position = b.position
  LEFT JOIN k ON m.conv_id IS NOT DISTINCT FROM k.conv_id AND m.position = k.position
  LEFT JOIN q ON m.conv_id IS NOT DISTINCT FROM q.conv_id AND m.position = q.position
), n AS (
  SELECT *, CAST(sum(CASE WHEN position = 1 OR parent_position <> position - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY position) AS BIGINT) AS branch FROM j
), d AS (
  SELECT conv_id, position, CAST(1 AS BIGINT) AS depth FROM n WHERE position = 1
  UNION ALL
  SELECT n.conv_id, n.position, d.depth + 1 FROM d JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.parent_position = d.position
), s AS (
  SELECT n.conv_id, n.branch, u.branch AS parent_branch FROM n JOIN n u ON n.conv_id IS NOT DISTINCT FROM u.conv_id AND n.parent_position = u.position
  WHERE n.parent_position <> n.position - 1
)
SELECT n.conv_id, turn, role, n.position, parent_position, n.branch, s.parent_branch, d.depth,
       CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, CAST(max_level AS BIGINT) AS max_level, body,
       '<|im_start|>' || coalesce(role, '') || chr(10) || body || '<|im_end|>' || chr(10) AS formatted
FROM n JOIN d ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.position = d.position
LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.branch = s.branch
"""
