"""Conversations rebuilt from reply links.

A walk goes from tweet to tweet for one customer. Backward it follows the parent while that is the
brand or the same customer; forward it takes the earliest answer of the brand, then the earliest
follow-up of the same customer. Both walks reduce to "the next tweet by the same author", so each
is a table with one next id per id. Such a table is joined with itself to give jumps of 2, 4, 8 ...
hops: a thread of a thousand tweets takes ten rounds of joins, not a thousand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.functions.text import parse_reply_ids
from replyloom.operators.jumps import Jumps, double_hops, follow, list_into_circle, list_walk
from replyloom.operators.spread import lookup
from replyloom.session import cut_lineage, literal_rows


class Threads:
    """The reply graph of one brand, or of several when ``brand`` is a column of ``tweets``.

    ``tweets`` needs tweet_id (unique, per brand), author_id, inbound, created_at (timestamp),
    response_tweet_id (comma list) and in_response_to_tweet_id (id). ``order_by`` names the column
    that says which of two seeds or equally early answers comes first.
    """

    def __init__(self, tweets: DataFrame, brand: str | None = None, order_by: str = "tweet_id",
                 per_customer: bool = False):
        self.per_customer = per_customer
        self.scoped = brand is None
        if brand is not None:
            tweets = tweets.withColumn("brand", F.lit(brand))
        own_id, parent_id = F.col("tweet_id"), F.col("in_response_to_tweet_id").cast("bigint")
        rows = tweets.select(
            self._node(own_id).alias("node"),
            F.when(parent_id.isNotNull(), self._node(parent_id)).alias("parent"),
            F.col("author_id").alias("author"),
            (F.lower("author_id") == F.lower("brand")).alias("is_brand"),
            "inbound",
            "created_at",
            F.col(order_by).alias("ord"),
            "response_tweet_id",
            "brand",
        )
        parents = rows.select(
            F.col("node").alias("p_node"), F.col("author").alias("p_author"),
            F.col("is_brand").alias("p_brand"),
        )
        self._joined = lookup(rows, parents, "parent", "p_node", "left")
        self._written = None

    @property
    def rows(self) -> DataFrame:
        """All tweets with the author of their parent; written once, when a walk first asks for them."""
        if self._written is None:
            self._written = cut_lineage(self._joined)
        return self._written

    def _once(self) -> DataFrame:
        """The same rows for those who read them once."""
        return self._joined if self._written is None else self._written

    def _node(self, tweet_id):
        return F.concat_ws("/", "brand", tweet_id) if self.scoped else tweet_id

    # --- seeds ---------------------------------------------------------------------------------

    def seeds(self) -> DataFrame:
        """(seed, customer, ord): inbound rows listing an existing answer of the brand."""
        rows = self._once()
        listed = rows.where(F.col("inbound") & F.col("response_tweet_id").isNotNull()).select(
            F.col("node").alias("seed"), F.col("author").alias("customer"), "ord", "brand",
            F.explode_outer(parse_reply_ids("response_tweet_id")).alias("reply_id"),
        ).where(F.col("reply_id").isNotNull())
        listed = listed.withColumn("reply", self._node(F.col("reply_id")))
        answers = rows.where("is_brand").select(F.col("node").alias("answer"))
        return (
            lookup(listed, answers, "reply", "answer", "left_semi")
            .select("seed", "customer", "ord")
            .distinct()
        )

    # --- adjacency -----------------------------------------------------------------------------

    def reply_edges(self) -> DataFrame:
        """(parent, child) for every row whose parent exists."""
        return self._once().where(F.col("p_author").isNotNull()).select(
            "parent", F.col("node").alias("child")
        )

    def parent_customers(self) -> DataFrame:
        """(tweet_id, customer): author of the parent unless that is missing or the brand."""
        return self._once().select(
            F.col("node").alias("tweet_id"),
            F.when(~F.col("p_brand"), F.col("p_author")).alias("customer"),
        )

    # --- backward ------------------------------------------------------------------------------

    def _run_edges(self) -> DataFrame:
        """Runs of brand rows: brand row to the parent that is a brand row too."""
        return self.rows.where(F.col("is_brand") & F.col("p_brand")).select(
            "node", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("dist")
        )

    def _prepare_backward(self):
        if hasattr(self, "back"):
            return
        if not hasattr(self, "runs"):
            self.runs = double_hops(self._run_edges())
        brand = self.rows.where("is_brand").select("node", "parent", "p_author", "p_brand")
        if self.runs.endless is not None:
            brand = brand.join(self.runs.endless, "node", "left_anti")
        tops = follow(brand, self.runs)
        top_rows = brand.select(
            F.col("node").alias("top"), F.col("parent").alias("exit"),
            F.col("p_author").alias("exit_author"),
        )
        # run(first, top, length, exit, exit_author): a run of brand rows and what comes before it
        runs = cut_lineage(
            lookup(tops, top_rows.withColumn("top_node", F.col("top")), "last", "top_node")
            .select(
                F.col("node").alias("first"), F.col("last").alias("top"),
                F.col("dist").alias("length"), "exit", "exit_author",
            )
        )
        walkers = self.rows.where(F.col("inbound") | ~F.col("is_brand")).select(
            "node", "author", "parent", "p_author", "p_brand"
        )
        steps = lookup(walkers, runs, "parent", "first", "left")
        over_run = F.col("p_brand") & F.col("top").isNotNull()
        through = over_run & (F.col("exit_author") == F.col("author"))
        direct = ~F.col("p_brand") & (F.col("p_author") == F.col("author"))
        # a run that goes round in a circle has no top: its walkers go hop by hop
        stuck = F.col("p_brand") & F.col("top").isNull()
        self.steps = cut_lineage(
            steps.select(
                "node",
                F.when(through, F.col("exit")).when(direct, F.col("parent")).alias("jump"),
                F.when(through, F.col("length") + 2).when(direct, F.lit(1)).alias("dist"),
                F.when(F.coalesce(over_run & ~F.coalesce(through, F.lit(False)), F.lit(False)),
                       F.col("top")).alias("tail_root"),
                F.when(over_run, F.col("length") + 1).otherwise(F.lit(0)).alias("tail_dist"),
                F.when(over_run, F.col("parent")).alias("run"),
                F.coalesce(stuck, F.lit(False)).alias("stuck"),
                F.when(F.coalesce(stuck, F.lit(False)), F.col("parent")).alias("stuck_at"),
            )
        )
        self.back = double_hops(
            self.steps.where(F.col("jump").isNotNull()).select(
                "node", "jump", F.col("dist").cast("bigint").alias("dist")
            )
        )

    def _roots(self):
        """(seed, customer, ord, root, depth) of seeds whose walk ends, and the other seeds."""
        self._prepare_backward()
        seeds = self.seeds()
        rest = None
        if self.back.endless is not None:
            rest = seeds.join(self.back.endless, seeds["seed"] == F.col("node"), "left_semi")
            seeds = seeds.join(self.back.endless, seeds["seed"] == F.col("node"), "left_anti")
        ends = follow(
            seeds.select(F.col("seed").alias("node")).distinct(), self.back
        )
        tails = self.steps.select(
            F.col("node").alias("end"), "tail_root", "tail_dist", "stuck",
            F.col("jump").isNull().alias("is_end"),
        )
        found = lookup(ends, tails, "last", "end", "left").select(
            F.col("node").alias("s"),
            F.coalesce("tail_root", "last").alias("root"),
            (F.col("dist") + F.when(F.col("tail_root").isNotNull(), F.col("tail_dist"))
             .otherwise(F.lit(0))).alias("depth"),
            F.coalesce("stuck", F.lit(False)).alias("stuck"),
        )
        located = cut_lineage(seeds.join(found, seeds["seed"] == found["s"]).drop("s"))
        if self.runs.endless is not None:
            stuck = located.where("stuck").select("seed", "customer", "ord")
            rest = stuck if rest is None else rest.unionByName(stuck)
        return located.where(~F.col("stuck")).drop("stuck"), rest

    def roots(self) -> DataFrame:
        """(seed, customer, ord, root, depth) for every seed."""
        located, rest = self._roots()
        if rest is None:
            return located
        paths = self._loop_backward(rest)
        deepest = paths.groupBy("seed", "customer", "ord").agg(
            F.max_by("node", "off").alias("root"), F.max("off").alias("depth")
        )
        return located.unionByName(deepest)

    def backward_paths(self, starts: DataFrame | None = None) -> DataFrame:
        """(walk, node, off): all rows of each seed's backward walk, counted from the seed.

        Of all seeds by default. ``walk`` holds the columns of the start, so what is known of a
        walk need not be joined to its rows again. Given ``starts`` have one seed per root and
        share next to no rows.
        """
        self._prepare_backward()
        seeds = self.seeds() if starts is None else starts
        carried = F.struct(*seeds.columns)
        plain, looped = self._split_endless(seeds)
        listed = cut_lineage(
            list_walk(
                plain.select(carried.alias("walk"), F.col("seed").alias("node"),
                             F.lit(0).alias("off")),
                self.back,
            )
        )
        entries = self.steps.where(F.col("run").isNotNull()).select(F.col("node").alias("n"), "run")
        in_runs = list_walk(
            lookup(listed, entries, "node", "n").select(
                F.struct("walk", "off").alias("walk"), F.col("run").alias("node"),
                (F.col("off") + 1).alias("off"),
            ),
            self.runs,
        ).select(F.col("walk")["walk"].alias("walk"), "node", "off")
        paths = listed.unionByName(in_runs)
        if looped is not None:
            hops = self._loop_backward(looped)
            paths = paths.unionByName(hops.select(carried.alias("walk"), "node", "off"))
        return paths

    def _split_endless(self, seeds):
        """Seeds whose walk ends, and those that run into a circle (None when there is none)."""
        if self.back.endless is None and self.runs.endless is None:
            return seeds, None
        ids = seeds.select("seed")
        bad = None
        if self.back.endless is not None:
            bad = self.back.endless.select(F.col("node").alias("seed"))
        if self.runs.endless is not None:
            located, rest = self._roots()
            extra = rest.select("seed")
            bad = extra if bad is None else bad.unionByName(extra)
        bad = cut_lineage(bad.join(ids, "seed", "left_semi").distinct())
        return seeds.join(bad, "seed", "left_anti"), seeds.join(bad, "seed", "left_semi")

    def _loop_backward(self, seeds: DataFrame) -> DataFrame:
        """Rows of walks that run into a circle of replies, each at its first place.

        A walk goes over customer rows (:attr:`back`), then maybe into a circle of brand rows alone. It is listed once round its
        circle and with all runs of brand rows between; from the first row that comes again on, all rows have
        come before, so the first places are the walk.
        """
        carried = F.struct(*[c for c in seeds.columns])
        starts = seeds.select(carried.alias("walk"), F.col("seed").alias("node"), F.lit(0).cast("bigint").alias("off"))
        listed = None
        if self.back.endless is not None:
            starts = cut_lineage(starts)
            listed = list_into_circle(starts.join(self.back.endless, "node", "left_semi"), self.back)
            starts = starts.join(self.back.endless, "node", "left_anti")
        plain = list_walk(starts, self.back)
        listed = cut_lineage(plain if listed is None else listed.unionByName(plain))
        entries = self.steps.where(F.col("run").isNotNull() | F.col("stuck")).select(
            F.col("node").alias("n"), F.when(F.col("stuck"), F.col("stuck_at")).otherwise(F.col("run")).alias("run"), "stuck"
        )
        entered = lookup(listed, entries, "node", "n").select(
            F.struct("walk", "off").alias("walk"), F.col("run").alias("node"), (F.col("off") + 1).alias("off"), "stuck"
        )
        in_runs = list_walk(entered.where(~F.col("stuck")).drop("stuck"), self.runs)
        if self.runs.endless is not None:
            in_runs = in_runs.unionByName(list_into_circle(entered.where("stuck").drop("stuck"), self.runs))
        rows = listed.unionByName(in_runs.select(F.col("walk")["walk"].alias("walk"), "node", "off"))
        return (
            rows.groupBy("walk", "node").agg(F.min("off").alias("off"))
            .select(F.col("walk.*"), "node", "off")
        )

    # --- forward -------------------------------------------------------------------------------

    def _prepare_forward(self):
        if not hasattr(self, "ahead"):
            self._forward_steps()
            self.ahead = double_hops(self.ahead_edges)

    def _forward_steps(self):
        if hasattr(self, "ahead_edges"):
            return
        when = F.coalesce(F.col("created_at"), F.lit("9999-12-31 00:00:00").cast("timestamp"))
        earliest = F.min(F.struct(when.alias("t"), F.col("ord").alias("o"), F.col("node").alias("n")))
        known = self.rows.where(F.col("p_author").isNotNull())
        # answer(of, answer): earliest brand row below a row that is not the brand's
        self.answers = cut_lineage(
            known.where(~F.col("p_brand") & F.col("is_brand"))
            .groupBy(F.col("parent").alias("of"))
            .agg(earliest.alias("e"))
            .select("of", F.col("e.n").alias("answer"))
        )
        # follow_up(after, by, follow_up): earliest row of an author below a brand row
        self.follow_ups = cut_lineage(
            known.where("p_brand")
            .groupBy(F.col("parent").alias("after"), F.col("author").alias("by"))
            .agg(earliest.alias("e"))
            .select("after", "by", F.col("e.n").alias("follow_up"))
        )
        customers = self.rows.where(~F.col("is_brand")).select("node", "author")
        # each answer has one parent, so neither join meets a key twice on either side
        via_answer = (
            customers.join(self.answers, customers["node"] == self.answers["of"])
            .join(self.follow_ups,
                  (F.col("answer") == F.col("after")) & (F.col("author") == F.col("by")))
            .select("node", F.col("follow_up").alias("jump"), F.lit(2).cast("bigint").alias("dist"))
        )
        own = self.rows.where(F.col("is_brand")).select("node", "author")
        self_replies = own.join(
            self.follow_ups, (F.col("node") == F.col("after")) & (F.col("author") == F.col("by"))
        ).select("node", F.col("follow_up").alias("jump"), F.lit(1).cast("bigint").alias("dist"))
        self.ahead_edges = via_answer.unionByName(self_replies)

    def _prepare_both(self):
        """Jump tables of runs and of the forward walk, which don't depend on each other, as one."""
        self._forward_steps()
        if hasattr(self, "ahead") or hasattr(self, "runs"):
            return
        tagged = [
            edges.select(F.struct(F.lit(kind).alias("of"), F.col("node").alias("id")).alias("node"),
                         F.struct(F.lit(kind).alias("of"), F.col("jump").alias("id")).alias("jump"), "dist")
            for kind, edges in enumerate((self._run_edges(), self.ahead_edges))
        ]
        both = double_hops(tagged[0].unionByName(tagged[1]))

        def of(kind: int, df: DataFrame) -> DataFrame:
            names = [F.col(c)["id"].alias(c) if c != "dist" else F.col(c) for c in df.columns]
            return df.where(F.col("node")["of"] == kind).select(names)

        def only(kind: int) -> Jumps:
            endless = None if both.endless is None else cut_lineage(of(kind, both.endless))
            levels = [of(kind, level) for level in both.levels]
            if endless is None or endless.isEmpty():
                return Jumps(levels)
            return Jumps(levels, endless, of(kind, both.cut), [of(kind, level) for level in both.open])

        self.runs, self.ahead = only(0), only(1)

    def forward_paths(self, starts: DataFrame) -> DataFrame:
        """(walk, root, customer) to (walk, node, off): rows after the root, counted from it."""
        self._prepare_forward()
        starts = starts.select("walk", "root", "customer")
        brand = self.rows.where("is_brand").select(F.col("node").alias("b"))
        # many customers may share one root
        at_brand = lookup(starts, brand, "root", "b", "left_semi")
        at_customer = lookup(starts, brand, "root", "b", "left_anti")
        first = at_brand.join(
            self.follow_ups, (F.col("root") == F.col("after")) & (F.col("customer") == F.col("by"))
        ).select("walk", F.col("follow_up").alias("node"), F.lit(1).cast("bigint").alias("off"),
                 "root", "customer")
        begin = first.unionByName(
            at_customer.select("walk", F.col("root").alias("node"),
                               F.lit(0).cast("bigint").alias("off"), "root", "customer")
        )
        looped = None
        if self.ahead.endless is not None:
            begin = cut_lineage(begin)
            looped = begin.join(self.ahead.endless, "node", "left_semi")
            begin = begin.join(self.ahead.endless, "node", "left_anti")
        listed = cut_lineage(list_walk(begin.select("walk", "node", "off"), self.ahead))
        answered = listed.join(self.answers, listed["node"] == self.answers["of"]).select(
            "walk", F.col("answer").alias("node"), (F.col("off") + 1).alias("off")
        )
        paths = listed.where(F.col("off") > 0).unionByName(answered)
        if looped is not None:
            paths = paths.unionByName(self._loop_forward(looped))
        return paths

    def _loop_forward(self, begin: DataFrame) -> DataFrame:
        """Rows of walks that run into a circle of replies, each at its first place, the root left out."""
        root = F.when(F.col("off") > 0, F.col("root"))
        starts = begin.select(F.struct("walk", root.alias("root")).alias("walk"), "node", "off")
        listed = cut_lineage(list_into_circle(starts, self.ahead))
        answered = listed.join(self.answers, listed["node"] == self.answers["of"]).select(
            "walk", F.col("answer").alias("node"), (F.col("off") + 1).alias("off")
        )
        first = listed.unionByName(answered).groupBy("walk", "node").agg(F.min("off").alias("off"))
        known_root = F.coalesce(F.col("walk")["root"] == F.col("node"), F.lit(False))
        return first.where((F.col("off") > 0) & ~known_root).select(F.col("walk")["walk"].alias("walk"), "node", "off")

    # --- conversations ---------------------------------------------------------------------------

    def winners(self) -> DataFrame:
        """One seed per root: the first whose conversation has at least two rows."""
        self._prepare_both()
        roots = cut_lineage(self.roots())
        has_next = self.answers.select(F.col("of").alias("at")).unionByName(
            self.rows.where("is_brand").select("node", "author").join(
                self.follow_ups, (F.col("node") == F.col("after")) & (F.col("author") == F.col("by"))
            ).select(F.col("node").alias("at"))
        )
        alone = roots.where(F.col("depth") == 0)
        long_enough = roots.where(F.col("depth") > 0).unionByName(
            alone.join(has_next, alone["seed"] == has_next["at"], "left_semi")
        )
        keys = ["root", "customer"] if self.per_customer else ["root"]
        picked = F.min(F.struct("ord", "seed", "customer", "depth", "root"))
        return cut_lineage(
            long_enough.groupBy(*keys).agg(picked.alias("w")).select("w.*")
        )

    def conversation_rows(self) -> DataFrame:
        """(root, customer, node, pos): rows of each conversation, ``pos`` from 0 without gaps.

        Backward chain first, then the forward one; a row in both keeps its earlier place.
        """
        won = self.winners()
        walk = F.col("walk")
        back = self.backward_paths(won).select(
            walk["root"].alias("root"), walk["customer"].alias("customer"),
            walk["depth"].alias("depth"), "node", (walk["depth"] - F.col("off")).alias("place"),
        )
        tagged = won.select(
            F.struct("root", "customer", "depth").alias("walk"), "root", "customer"
        )
        ahead = self.forward_paths(tagged).select(
            walk["root"].alias("root"), walk["customer"].alias("customer"),
            walk["depth"].alias("depth"), "node", (walk["depth"] + F.col("off")).alias("place"),
        )
        rows = cut_lineage(
            back.unionByName(ahead)
            .groupBy("root", "customer", "depth", "node")
            .agg(F.min("place").alias("place"))
            .withColumn("conversation", F.concat_ws("/", "root", "customer"))
        )
        return self._close_gaps(rows)

    def _close_gaps(self, rows: DataFrame) -> DataFrame:
        """Number the rows without gaps.

        The forward chain repeats the backward one up to where they part, so the rows beyond the
        seed are moved down by as many places as were repeated.
        """
        beyond = F.col("place") > F.col("depth")
        first = (
            rows.where(beyond)
            .groupBy(F.col("conversation").alias("of"))
            .agg(F.min(F.col("place") - F.col("depth") - 1).alias("gap"))
            .where(F.col("gap") > 0)
        )
        moved = lookup(rows, first, "conversation", "of", "left")
        return moved.select(
            "root", "customer", "node",
            (F.col("place") - F.when(beyond, F.coalesce("gap", F.lit(0))).otherwise(0)).alias("pos"),
        )


def build_conversations(tweets: DataFrame, brand: str | None = None, order_by: str = "tweet_id",
                        per_customer: bool = False) -> DataFrame:
    """Flat conversations: conversation_id, customer_id, pos, tweet columns, turn_count per brand."""
    threads = Threads(tweets, brand, order_by, per_customer)
    placed = threads.conversation_rows()
    if brand is None:
        placed = placed.select(
            "customer", "pos",
            F.expr("substring_index(node, '/', -1)").cast("bigint").alias("tweet_id"),
            F.expr("substring_index(root, '/', -1)").cast("bigint").alias("root_id"),
            F.expr("left(node, length(node) - length(substring_index(node, '/', -1)) - 1)")
            .alias("brand"),
        )
    else:
        tweets = tweets.withColumn("brand", F.lit(brand))
        placed = placed.select(
            "customer", "pos", F.col("node").alias("tweet_id"), F.col("root").alias("root_id"),
            F.lit(brand).alias("brand"),
        )
    detail = tweets.select("tweet_id", "brand", "author_id", "inbound", "created_at", "text")
    # a tweet is in at most two conversations, so this key is never hot
    return placed.join(detail, ["brand", "tweet_id"]).select(
        F.concat_ws("_", "brand", F.col("root_id").cast("string")).alias("conversation_id"),
        F.col("customer").alias("customer_id"),
        F.col("pos").cast("bigint").alias("pos"),
        "brand", "tweet_id", "author_id", "inbound", "created_at", "text",
    )


def conversation_lengths(flat: DataFrame) -> DataFrame:
    """Rows per conversation."""
    return flat.groupBy("conversation_id", "customer_id", "brand").agg(
        F.count(F.lit(1)).alias("turn_count")
    )


def nest_conversations(flat: DataFrame) -> DataFrame:
    """One row per conversation with its messages in order, as the JSON sink writes them."""
    message = F.struct(
        "pos", "tweet_id", "author_id", "inbound", F.col("created_at").cast("string").alias("created_at"),
        "text",
    )
    return (
        flat.groupBy("conversation_id", "customer_id")
        .agg(F.sort_array(F.collect_list(message)).alias("m"))
        .select(
            "conversation_id",
            "customer_id",
            F.transform("m", lambda x: x.dropFields("pos")).alias("messages"),
            F.size("m").cast("bigint").alias("turn_count"),
        )
    )


def conversation_stats(connected: DataFrame, lengths: DataFrame,
                       brands: list[str]) -> DataFrame:
    """Per brand: rows, conversations, mean, median and maximum length, counts of 3+ and 6+.

    A brand without rows or conversations keeps its line with zeros.
    """
    asked = literal_rows(connected.sparkSession, ["brand"], [(b,) for b in brands])
    tweets = connected.groupBy("brand").agg(F.count(F.lit(1)).alias("tweets"))
    threads = lengths.groupBy("brand").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.round(F.avg("turn_count"), 2).alias("avg_turns"),
        F.median("turn_count").alias("median_turns"),
        F.max("turn_count").alias("max_turns"),
        F.count_if(F.col("turn_count") >= 3).alias("conversations_3plus"),
        F.count_if(F.col("turn_count") >= 6).alias("conversations_6plus"),
    )
    zero = ["tweets", "conversations", "conversations_3plus", "conversations_6plus"]
    return asked.join(tweets, "brand", "left").join(threads, "brand", "left").fillna(0, zero)
