"""Inputs of the registered queries: driver tables, and tables of the library's shapes that SQL derives from them.

Each derived table is one SELECT that Spark and DuckDB both run, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def pick(options: str, key: str) -> str:
    """SQL: one of the '~'-separated options, by ``key``."""
    n = len(options.split("~"))
    return f"split_part('{options}', '~', cast(({key}) % {n} as int) + 1)"


#: Downloaded documents: one row a part.
DOWNLOADS = f"""
select p_partkey as k,
  'https://' || {pick('www.alpha.gov.example~beta.example.org~docs.beta.example.org~Gamma.Example.com:443~delta.example.net~www.epsilon.example', 'p_partkey')} || '/'
    || {pick('laws~news~media/press~documents/legal~Circulars~about-us~getattachment/ab12~en//regulations~library~careers~getfile', 'floor(p_partkey / 2)')} || '/'
    || {pick('BankingControlLaw~annual_report~Bill12of~circular-no~IoT-guide~Ord9of~notice_en~PAC-~decision_fr~whitepaper~Gesetz~committee~D1234567890', 'floor(p_partkey / 3)')}
    || cast(1985 + p_partkey % 60 as string) || {pick('.pdf~.pdf.aspx~.docx~.html~~.PDF~.xlsx~;jsessionid=1.pdf', 'floor(p_partkey / 5)')}
    || {pick('~?utm_source=x&id=5~?gclid=1~?a=b#frag~?page=2&fbclid=zz~#top~?mc_cid=7&q=1', 'floor(p_partkey / 7)')} as url,
  {pick('Banking Control Law~PDF~Annual report 2019~Read more~Circular on licensing rules~Notice of appointment~  White   paper on data ~~Bill 12 of 2021~Ordinance on parks~Resolution 7~Standing committee report~Hansard agenda', 'floor(p_partkey / 4)')} as title,
  {pick('Bill12of2021.pdf~Ord9of2020.pdf~2023-12345.pdf~D20240001234.pdf~u1234567.pdf~FC-Official-Report.pdf~parl-3of2022.pdf~notes_en.pdf~law_fr.pdf~plain.pdf~~guide_de.pdf', 'floor(p_partkey / 6)')} as filename,
  {pick('UK~US - Federal~Canada - Ontario~New York~France~Germany~Saudi Arabia~Atlantis~~India', 'floor(p_partkey / 3)')} as jurisdiction,
  {pick('official_gazette~parliamentary_bills~legal_databases~custom~site', 'p_partkey')} as source_kind,
  '202' || cast(p_partkey % 6 as string) || '-0' || cast(1 + p_partkey % 9 as string) || '-1' || cast(p_partkey % 10 as string) || 'T00:00:00Z' as downloaded_at,
  cast((p_partkey * 7919) % 4000000 as bigint) as bytes, md5(cast(p_partkey % 1500 as string)) as sha256,
  p_size, p_brand, p_type, p_name,
  {pick('downloaded~to_download~download_failed~scanned_pdf~downloaded', 'floor(p_partkey / 2)')} as status,
  {pick('href~embedded-url~quoted-path~datasource~sitemap', 'floor(p_partkey / 9)')} as discovery_method
from part
"""

#: The authority registry: one row a supplier.
REGISTRY = f"""
select s_suppkey as k, r_name as region,
  {pick('UK~US - Federal~Canada - Ontario~New York~France~usa~Germany~Hongkong~Australia - Victoria~~Republic of Korea~Quebec~Canada – Federal~Federal Republic', 's_suppkey')} as jurisdiction,
  {pick('Bank of ~Ministry ~Securities Board ~Data Office ~~Tax Agency ', 's_suppkey')} || n_name as authority,
  {pick('https://www.alpha.gov.example/a~https://beta.example.org~http://docs.beta.example.org/x~https://Gamma.Example.com/~delta.example.net~~https://sub.epsilon.example/q~https://zeta.co.example', 'floor(s_suppkey / 2)')} as url,
  {pick('Frequent~Less Frequent~Most Frequent~', 's_suppkey')} as frequency,
  {pick('Capital Markets~Private & Capital~tax; Banking,Tax~private market~~Data', 's_suppkey')} as segment,
  {pick('active~broken~active~active', 's_suppkey')} as status,
  {pick('HTML page~link not working~RSS', 's_suppkey')} as link_nature,
  {pick('Statutory~Self-regulatory~', 's_suppkey')} as authority_type,
  {pick('licensing,reporting~privacy~~a,b,c,d,e,f', 's_suppkey')} as topics, n_name
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

#: Change candidates: one row an order of the first 3000 keys a scale step, with repeated links.
UPDATES = f"""
select o_orderkey as k, md5(cast(o_orderkey as string)) as id,
  {pick('UK~US - Federal~Canada~New York~~France', 'o_orderkey')} as country, {pick('EMEA~AMER~APAC', 'o_orderkey')} as region,
  {pick('~Data Office~Bank of X', 'o_orderkey')} as authority, {pick('Capital Markets~tax;Tax, Banking~~Private & Capital', 'o_orderkey')} as law_area,
  {pick('licensing,reporting,a,b,c~privacy~', 'o_orderkey')} as topical_relevance,
  {pick('Read more~New circular on ~ Click here ~Consultation   about ~Press release ', 'floor(o_orderkey / 2)')} || {pick('~bonds~privacy~taxes', 'o_orderkey')} as title,
  {pick('https://www.alpha.gov.example/n/~https://BETA.example.org/u/~https://x.delta.example.net/~', 'o_orderkey')} || cast(o_orderkey % 997 as string) as link,
  {pick('https://www.alpha.gov.example/n~~', 'floor(o_orderkey / 3)')} as source_url, {pick('Pending~High~~seed', 'o_orderkey')} as relevancy,
  {pick('~open~closed', 'o_orderkey')} as alert_status, cast(cast(o_orderdate as date) as string) as discovered_at
from orders
"""

#: The analysts' log: one row a customer.
TRACKING = f"""
select c_custkey as k, {pick('Canada~USA~UK~Australia~Korea~', 'c_custkey')} as country, {pick('Federal~Ontario~~Victoria~federal~Texas', 'floor(c_custkey / 2)')} as federal_or_state,
  {pick('Capital & Private~capital market~Tax~', 'c_custkey')} as law_area, {pick('licensing; reporting~privacy~~one,two,three,four,five', 'c_custkey')} as topical_relevance,
  {pick('https://www.alpha.gov.example/n/~https://beta.example.org/u/~https://epsilon.example/t/~', 'c_custkey')} || cast(c_custkey % 400 as string) as link,
  {pick('CSA adopts rule ~~Read more~Long remark about ', 'floor(c_custkey / 3)')} || {pick('~bonds~c_mkt', 'c_custkey')} as remarks,
  {pick('High~Low~Pending~', 'c_custkey')} as relevancy, {pick('~checked by desk', 'c_custkey')} as comments, {pick('~2021-03-04', 'c_custkey')} as date_of_publication,
  '2022-01-0' || cast(1 + c_custkey % 9 as string) as date_of_tracking, {pick('open~~closed', 'c_custkey')} as alert_status, c_mktsegment as tracked_by
from customer
"""

#: Fetch runs: one row an event.
RUNS = f"""
select event_id as k, 'source-' || cast(user_id % 40 as string) as source, ts as started_at,
  case event_type when 'error' then 'error' when 'signup' then 'http_error' else 'ok' end as status,
  cast(case event_type when 'error' then 0 when 'signup' then 503 else 200 end as int) as http_status,
  md5(cast(cast(floor(value) as bigint) % 5 as string)) as content_hash, cast(event_id % 4 as int) as item_count, cast(event_id % 3 as int) as new_items,
  'https://h' || cast(user_id % 17 as string) || '.example.org/p/' || cast(event_id % 50 as string) as url, event_id, user_id, event_type, value, ts
from events
"""

#: Summaries corpus: one row a document.
CORPUS = f"""
select doc_id as id, split_part(text, '.', 1) as title, {pick('UK~France~Saudi Arabia~Data Authority', 'doc_id')} as jurisdiction, source as source_kind,
  'https://' || source || '.example.org/d/' || cast(doc_id as string) as url, text, lang,
  text as summary, 'T' || cast(doc_id % 977 as string) as summarized_at
from documents
"""

DERIVED = {"downloads": DOWNLOADS, "registry": REGISTRY, "updates": UPDATES, "tracking": TRACKING, "runs": RUNS, "corpus": CORPUS}


#: Narrow tables whose few files hold many rows, by key.
KEYS = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "events": "event_id"}


#: Rows of a narrow table in a piece of it, at most some so many: what a task sorts or holds of them does not grow with the table.
PIECE_ROWS = 100_000


def dealt(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; a narrow one in fewer pieces than there are cores, or of over ``PIECE_ROWS`` rows each, is dealt out by its key, as a row of it is little to read and much work.

    The number of pieces is given, as Spark would join small ones again.
    """
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table not in KEYS:
        return rows
    cores, least = spark.sparkContext.defaultParallelism, -(-rows.count() // PIECE_ROWS)
    return rows.repartition(max(3 * cores, least), KEYS[table]) if rows.rdd.getNumPartitions() < max(cores, least) else rows


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived table."""
    if name not in DERIVED:
        return dealt(spark, sf_dir, name)
    for table in TABLES:
        if f" {table} " in f"{DERIVED[name]} ".replace("\n", " "):
            dealt(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(DERIVED[name])


def with_inputs(sql: str, *names: str) -> str:
    """DuckDB SQL that reads the derived tables ``names`` as if they were tables."""
    heads = ", ".join(f"{n} as ({DERIVED[n]})" for n in names)
    if sql.strip().lower().startswith("with recursive "):
        return f"with recursive {heads}, {sql.strip()[15:]}"
    return f"with {heads} {', ' + sql.strip()[5:] if sql.strip().lower().startswith('with ') else sql}"


def projection(queries: dict, sql: dict):
    """A function that registers a projection of one derived table: columns made from (url, title), and their SQL."""

    def register(name: str, table: str, columns, oracle: dict[str, str]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = columns(F.col("url"), F.col("title"))
            return load(spark, sf_dir, table).select("k", *[c.alias(n) for n, c in made.items()])

        queries[name] = run
        sql[name] = with_inputs(f"select k, {', '.join(f'{e} as {n}' for n, e in oracle.items())} from {table}", table)

    return register


def with_bigints(sql: str) -> str:
    """``sql`` with its named counts and sums as 64-bit integers, as Spark has them."""
    return re.sub(r"\b(count_if|sum)\(((?:[^()]|\([^()]*\))*)\) as (?!bigint)", r"cast(\1(\2) as bigint) as ", sql)
