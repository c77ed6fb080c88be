"""Lexical retrieval over batches of questions, passages, extractive summaries and cited answers."""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rank import keep_top, relative_cutoff, topic_terms
from .storage import numbered, saved

#: Words that no question or document is found by.
STOP = (
    "the", "and", "for", "are", "you", "your", "what", "when", "where", "which", "who", "how", "does", "did", "with", "from", "that", "this", "have", "has",
    "was", "were", "will", "can", "could", "would", "should", "about", "into", "more", "any", "all", "our", "its", "not", "but", "also", "than", "then",
    "them", "they", "there", "these", "those", "please", "tell", "give", "show", "read", "reading", "pdf", "pdfs", "document", "documents", "file", "files",
)
#: Words of legal sentences.
LEGAL_WORDS = (
    "shall", "regulation", "amend", "act", "bill", "article", "section", "authority", "ministry", "license", "compliance", "tax", "bank",
    "cyber", "data", "privacy", "insurance", "securities", "competition",
)
#: Runs of characters that tokens are made of; whatever contains a token contains it in one of these.
_RUNS = re.compile("[a-z0-9]+|[\u0600-\u06FF]+")


def tokens(text: Column) -> Column:
    """Distinct Latin tokens of three characters or more and Arabic ones of two, in lower case, without stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]{3,}"), 0), F.regexp_extract_all(low, F.lit(r"[\x{0600}-\x{06FF}]{2,}"), 0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP]))


class Questions:
    """A block of questions as executors use it: its tokens, which question asks for which, and how questions begin.

    Points a document gets for a token: 1 if it is one of its words, 4 if one of the title's; 2 if the jurisdiction
    contains it, and, for tokens of four letters, 2 if the title and 1 if the summary does.
    """

    def __init__(self, qids: list, raws: list[str], asked: list[list[str]]) -> None:
        self.qids = qids
        self.place = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
        self.asks = np.zeros((len(self.place), len(qids)), np.float32)
        for q, tokens in enumerate(asked):
            self.asks[[self.place[t] for t in tokens], q] = 1
        self.starts: dict[str, list[str]] = {}
        for t in self.place:
            self.starts.setdefault(t[: 3 if t.isascii() else 2], []).append(t)
        self.long = np.array([len(t) >= 4 for t in self.place], np.float32)
        self.heads: dict[str, list[tuple[str, int]]] = {}
        for q, raw in enumerate(raws):
            if len(raw) >= 6:
                self.heads.setdefault(raw[:6], []).append((raw[:40], q))
        self.known: dict[str, tuple[int, ...]] = {}

    def inside(self, word: str) -> tuple[int, ...]:
        """The tokens that a word contains, found by their first characters."""
        n, starts = 3 if word.isascii() else 2, self.starts
        return tuple({self.place[t] for i in range(len(word) - n + 1) if (own := starts.get(word[i : i + n])) for t in own if word.startswith(t, i)})

    def points(self, title: str, place: str, summary: str) -> np.ndarray:
        """A document's points for each token."""
        held = [set(_RUNS.findall(x)) for x in (title, place, summary)]
        words, known, index = set().union(*held), self.known, self.place
        if len(known) > 300_000:
            known.clear()
        for word in words.difference(known):
            known[word] = self.inside(word)
        row, once = np.zeros(len(index), np.float32), np.zeros(len(index), np.float32)
        for own, weight, any_length in zip(held, (2, 2, 1), (False, True, False)):
            contained = list(set().union(*map(known.__getitem__, own)))
            once[:] = 0
            once[contained] = weight
            row += once if any_length else once * self.long
        row[[index[w] for w in words.intersection(index)]] += 1
        row[[index[w] for w in held[0].intersection(index)]] += 4
        return row

    def headed(self, title: str) -> set[int]:
        """Questions whose beginning the title contains."""
        if not self.heads:
            return set()
        return {q for i in range(len(title) - 5) if (own := self.heads.get(title[i : i + 6])) for head, q in own if title.startswith(head, i)}


class _Best:
    """One task's best ``k`` documents of each question; ties by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.ones(n, np.float32)
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.float32), []
        self.waiting: list[tuple] = []

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((q, score, ids))
        if sum(len(x[0]) for x in self.waiting) > 50_000:
            self.settle()

    def settle(self) -> None:
        """Keep the best, and what a question's next document must reach."""
        if not self.waiting:
            return
        parts = [(self.q, self.score, self.ids), *self.waiting] if len(self.q) else self.waiting
        q, score, ids = (np.concatenate(x) for x in zip(*parts))
        by_id = np.empty(len(ids), np.int64)
        by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.lexsort((by_id, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = rank == self.k - 1
        self.least[q[last]] = score[last]
        kept = rank < self.k
        self.q, self.score, self.ids, self.waiting = q[kept], score[kept], ids[kept], []


def retrieve(questions: DataFrame, corpus: DataFrame, k: int = 8, block: int = 512, block_tokens: int = 16_384) -> DataFrame:
    """(qid, id, score, rank): the documents that answer each question best.

    questions (qid, question), corpus (id, title, jurisdiction, summary). A document scores a point for each token it
    shares, four more where the title has it, two where its jurisdiction contains it, and for tokens of four letters two
    where the title and one where the summary contains them; six where the title contains the question's first forty
    characters (of six or more).

    All scoring documents count, those too that only contain a token inside a longer word. Questions go out in blocks of
    about ``block`` questions and ``block_tokens`` tokens; every block is one pass over the corpus. A task scores its
    documents batch by batch, leaves out questions that no document of a batch can gain by (the best points of the batch for
    each token bound its scores), and sends on its best ``k`` documents of each question, so no list of documents is joined
    with a token, however common. An empty question or corpus gives no rows; null texts are empty.
    """
    q = saved(questions.select("qid", F.lower(F.trim(F.coalesce("question", F.lit("")))).alias("raw"), tokens(F.col("question")).alias("asked")))
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("asked")), F.lit(0)).alias("t")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["t"] // block_tokens))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
    docs = corpus.select("id", low("title"), low("jurisdiction"), low("summary"))
    kinds = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.IntegerType())])
    parts = []
    for i in range(blocks):
        own = q.where(F.pmod(F.xxhash64("qid", "raw"), F.lit(blocks)) == i).collect()
        if own:
            sent = q.sparkSession.sparkContext.broadcast(Questions([r["qid"] for r in own], [r["raw"] for r in own], [r["asked"] for r in own]))
            parts.append(docs.mapInArrow(_scorer(sent, k, kinds["qid"].dataType), kinds))
    if not parts:
        return docs.sparkSession.createDataFrame([], kinds).withColumn("rank", F.lit(0))
    return relative_cutoff(reduce(DataFrame.unionByName, parts), "qid", k, 0.35, 6, 1.0, F.col("id"))


def _scorer(sent, k: int, qid_type: T.DataType, rows: int = 256):
    """The function that scores a task's documents for the questions ``sent``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    qid_type = to_arrow_type(qid_type)

    def run(batches):
        block = sent.value
        best = _Best(len(block.qids), k)
        id_type = None
        for whole in batches:
            id_type = whole.column("id").type
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                texts = list(zip(*(batch.column(c).to_pylist() for c in ("title", "jurisdiction", "summary"))))
                points = np.stack([block.points(*t) for t in texts]) if len(block.place) else np.zeros((len(texts), 0), np.float32)
                extra = np.zeros((len(texts), len(block.qids)), np.float32)
                for d, (title, _, _) in enumerate(texts):
                    for question in block.headed(title):
                        extra[d, question] = 6
                held = points.any(0)
                bound = points[:, held].max(0) @ block.asks[held] + extra.max(0)
                open_ = np.flatnonzero(bound >= best.least)
                scores = points[:, held] @ block.asks[np.ix_(held, open_)] + extra[:, open_]
                d, at = np.nonzero(scores >= best.least[open_])
                best.add(open_[at], scores[d, at], ids[d])
        best.settle()
        if len(best.q):
            qids = [block.qids[i] for i in best.q]
            yield pa.RecordBatch.from_arrays([pa.array(qids, qid_type), pa.array(best.ids, id_type), pa.array(best.score.astype(np.int32))], ["qid", "id", "score"])

    return run


def _windows(text: Column, step: int, width: int) -> Column:
    """The trimmed windows of ``width`` characters that start every ``step``, put together from blocks of ``step`` characters: a text is gone through once."""
    near = lambda blocks, i: F.array_join(F.slice(blocks, i + 1, -(-width // step)), "")
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0), lambda blocks: F.transform(blocks, lambda _, i: F.trim(F.substring(near(blocks, i), 1, width))))


def passages(hits: DataFrame, questions: DataFrame, texts: DataFrame, step: int = 500, width: int = 650, top: int = 3, docs: int = 3, least: int = 50, once: int | None = None) -> DataFrame:
    """(qid, id, passage, score, start, nth): the best windows of each question's best documents.

    hits (qid, id, rank), texts (id, text). Windows start every ``step`` characters of the whole text. Of passages that
    start with the same ``once`` characters the best counts alone. The client's profile is step 400, width 550, least 40,
    once 80. The questions' tokens are written first, so Spark knows their size: few questions go to the windows, which are
    made once, and not the windows to each part of the questions.
    """
    wanted = hits.where(F.col("rank") <= docs).select("qid", "id")
    q = saved(questions.select("qid", tokens(F.col("question")).alias("qt")))
    cut = wanted.groupBy("id").agg(F.collect_list("qid").alias("qids")).join(texts.select("id", "text"), "id")
    windows = cut.select("id", "qids", F.posexplode(_windows(F.col("text"), step, width)).alias("nth", "passage")).where(F.length("passage") >= least)
    windows = windows.select("id", "qids", (F.col("nth") * step).alias("start"), "passage", tokens(F.col("passage")).alias("wt"))
    scored = windows.withColumn("qid", F.explode("qids")).join(q, "qid").withColumn("score", F.size(F.array_intersect("qt", "wt"))).where("score >= 1")
    if once:
        first = F.min_by(F.struct("passage", "score", "start"), F.struct(-F.col("score"), F.col("start"))).alias("p")
        scored = scored.groupBy("qid", "id", F.substring("passage", 1, once)).agg(first).select("qid", "id", "p.*")
    return keep_top(scored.select("qid", "id", "passage", "score", "start"), ["qid", "id"], top, F.desc("score"), F.col("start"), name="nth")


def sentences(docs: DataFrame) -> DataFrame:
    """(id, pos, sentence, points, size): sentences of 40 to 400 characters and the legal words in them."""
    parted = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n+")
    rows = docs.select("id", F.posexplode(parted).alias("pos", "sentence")).select("id", "pos", F.trim("sentence").alias("sentence")).withColumn("size", F.length("sentence"))
    points = sum((F.lower("sentence").contains(w).cast("int") for w in LEGAL_WORDS), F.lit(0))
    return rows.where(F.col("size").between(40, 400)).withColumn("points", points)


def extractive_summaries(docs: DataFrame, n: int = 5) -> DataFrame:
    """(id, summary, key_points, topics, method) for docs (id, title, text): the ``n`` most legal sentences, longest first.

    Without such sentences the first 500 characters; a blank text has a fixed summary and no points.
    """
    top = keep_top(sentences(docs), ["id"], n, F.desc("points"), F.desc("size"), F.col("pos"))
    points = top.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]).alias("key_points"))
    joined = docs.join(points, "id", "left").join(topic_terms(docs), "id", "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    points = F.coalesce("key_points", F.array(F.substring("text", 1, 500)))
    body = F.substring(F.array_join(points, " "), 1, 1200)
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(". "), body)).otherwise(body)
    return joined.select(
        "id", F.when(blank, F.lit("No extractable text (may be scanned/image-only PDF).")).otherwise(F.trim(titled)).alias("summary"),
        F.when(blank, F.array().cast("array<string>")).otherwise(points).alias("key_points"), F.when(blank, F.lit("")).otherwise(F.coalesce("topics", F.lit(""))).alias("topics"),
        F.when(blank, F.lit("empty")).otherwise(F.lit("extractive")).alias("method"),
    )


def answers(questions: DataFrame, hits: DataFrame, corpus: DataFrame, most: int = 6, points: int = 2) -> DataFrame:
    """(qid, answer, n): an answer to each question from its best documents, with references to all of them.

    hits (qid, id, rank, and passage, its best window, which may be null), corpus (id, title, url, summary, key_points).
    Each of the first ``most`` documents gives its first ``points`` key points, or 260 characters of its summary if it has
    none, and then 280 of its passage.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cited = hits.join(corpus.select("id", "title", "url", "summary", "key_points"), "id")
    mark = F.concat(F.lit("• ["), F.col("rank").cast("string"), F.lit("] "))
    said = F.when(F.coalesce(F.size("key_points"), F.lit(0)) > 0, F.slice("key_points", 1, points)).otherwise(F.array(F.substring(text("summary"), 1, 260)))
    lines = F.concat(F.transform(said, lambda p: F.concat(mark, p)), F.when(text("passage") != "", F.array(F.concat(F.lit("  “"), F.substring("passage", 1, 280), F.lit("”")))).otherwise(F.array().cast("array<string>")))
    ref = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), text("title"), F.lit(" — "), text("url"))
    parts = cited.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.array_join(lines, "\n").alias("line"), ref.alias("ref")))).alias("c"))
    body = F.concat_ws("\n", F.lit("Answer:"), F.array_join(F.transform(F.slice("c", 1, most), lambda x: x["line"]), "\n"), F.lit("\nReferences:"), F.array_join(F.transform("c", lambda x: x["ref"]), "\n"))
    found = parts.select("qid", body.alias("answer"), F.size("c").alias("n"))
    none = F.lit("I could not find relevant summaries for that question yet.")
    return questions.select("qid").join(found, "qid", "left").select("qid", F.coalesce("answer", none).alias("answer"), F.coalesce("n", F.lit(0)).alias("n"))


def corpus_listing(corpus: DataFrame, *order: Column) -> DataFrame:
    """(n, id, title, jurisdiction, url, line): every document of the corpus as a numbered citation, the answer to a request for the list.

    The list has a row a document and is numbered by ranges of ``order``, so it is never one value or one task's.
    """
    some = lambda c, otherwise: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(otherwise))
    rows = numbered(corpus.select("id", some("title", "Untitled").alias("title"), some("jurisdiction", "—").alias("jurisdiction"), some("url", "").alias("url")), "n", *order)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "title", F.lit(" ("), "jurisdiction", F.lit(")"))
    return rows.select("n", "id", "title", "jurisdiction", "url", line.alias("line"))


def corpus_status(corpus: DataFrame) -> DataFrame:
    """(jurisdiction, n, with_summary, first_url): what the corpus holds, the answer to a question about its state."""
    return corpus.groupBy("jurisdiction").agg(F.count("*").alias("n"), F.count_if(F.length("summary") > 20).alias("with_summary"), F.min("url").alias("first_url"))


#: Fixed value: the white space that goes after a cut.
BLANKS = r"^[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(text: Column, size: int = 900) -> Column:
    """``text`` in pieces of at most ``size`` characters (code points), in order.

    A piece ends at the last blank in the first ``size`` + 1 characters or, where that leaves under 40 % of ``size``, at the
    last line end, or else after ``size``; white space after a cut goes. Each cut depends on the one before: the text is
    taken apart into blocks of ``size`` characters once, and a fold goes from cut to cut, each time over the three blocks
    in which the next cut lies. Its state is a place and where each piece so far begins and how long it is.
    """
    least = ceil(0.4 * size)
    last = lambda s, c: F.length(s) - F.instr(F.reverse(s), c)  # noqa: E731  (its length where c is not in s)
    usable = lambda s, at: (at >= least) & (at < F.length(s))

    def cut(head: Column) -> Column:
        line = _let(last(head, "\n"), lambda at: F.when(usable(head, at), at).otherwise(size))
        blank = _let(last(head, " "), lambda at: F.when(usable(head, at), at).otherwise(line))
        return F.when(F.length(head) <= size, F.length(head)).otherwise(blank)

    def window(blocks: Column, at: Column) -> Column:
        return F.substr(F.array_join(F.slice(blocks, F.floor(at / size).cast("int") + 1, 3), ""), at % size + 1)

    def step(blocks: Column, state: Column) -> Column:
        moved = lambda by: (state["at"] + by).cast("int").alias("at")

        def piece(w: Column, lead: Column) -> Column:
            head = F.substr(w, lead + 1, F.lit(size + 1))
            taken = _let(head, lambda h: _let(cut(h), lambda n: F.struct(moved(lead + n), F.concat(state["out"], F.array((state["at"] + lead).cast("int"), n)).alias("out"))))
            return F.when((lead > size) | (lead == F.length(w)), F.struct(moved(lead), state["out"].alias("out"))).otherwise(taken)

        return _let(window(blocks, state["at"]), lambda w: _let(F.when(state["at"] > 0, F.length(F.regexp_extract(w, BLANKS, 0))).otherwise(0), lambda lead: piece(w, lead)))

    def fold(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        steps = F.sequence(F.lit(0), F.floor(F.size(blocks) * size / least).cast("int"))
        places = F.aggregate(steps, start, lambda state, _: step(blocks, state), lambda state: state["out"])
        piece = lambda out, i: F.substr(window(blocks, F.get(out, 2 * i)), F.lit(1), F.get(out, 2 * i + 1))
        return _let(places, lambda out: F.when(F.size(out) > 0, F.transform(F.sequence(F.lit(0), (F.size(out) / 2).cast("int") - 1), lambda i: piece(out, i))).otherwise(F.array().cast("array<string>")))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0), fold)


def chunk_text(docs: DataFrame, size: int = 900) -> DataFrame:
    """(id, n, chunk): the texts (id, text) in pieces (see ``chunks``), numbered from 0; empty and null texts have none."""
    return docs.select("id", F.posexplode(chunks(F.col("text"), size)).alias("n", "chunk"))


#: The columns of published summaries.
COMPACT = ["id", "title", "jurisdiction", "source_kind", "url", "open_url", "source_page", "summary", "key_points", "topics", "document_type", "method", "summarized_at"]


def publish_summaries(summaries: DataFrame, most: int = 5000) -> DataFrame:
    """The newest ``most`` summaries in the columns ``COMPACT``: absent ones are null, lists empty, open_url at least the url."""
    kinds = dict(summaries.dtypes)
    col = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    lists = {c: F.coalesce(F.col(c) if kinds.get(c, "").startswith("array") else F.lit(None), F.array().cast("array<string>")) for c in ("key_points", "topics")}
    made = {**lists, "open_url": F.coalesce(F.nullif(col("open_url"), F.lit("")), col("url"))}
    newest = summaries.orderBy(F.desc(F.coalesce("summarized_at", F.lit(""))), "id").limit(most)
    return newest.select(*[made.get(c, col(c)).alias(c) for c in COMPACT])


def publish_meta(summaries: DataFrame, most: int = 5000) -> DataFrame:
    """(count, total_indexed, updated_at): how many summaries are published, how many there are, and when the newest was made."""
    total = F.count("*")
    return summaries.agg(F.least(total, F.lit(most)).cast("long").alias("count"), total.alias("total_indexed"), F.max("summarized_at").alias("updated_at"))
