"""The given tables, and the views derived from them that stand in for the domain's own tables.

Every derived view is one SQL text that Spark and DuckDB both run unchanged, so a query and its check read the same rows.
All of them read whole tables: a view may reshape rows by their ids, it never drops any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegrain.session import SPREAD, join_by_measure, widen_shuffles

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

# Tables whose rows cost much work each (text, markup, long expressions).
WIDE_ROWS = ("pages", "documents", "events", "part", "conversations")
# Narrow tables whose rows become pages, cards and reads: a file of a few megabytes is scanned by a few tasks, so it is dealt out by rows.
ROWS_A_TASK = {"part": 4_000, "events": 20_000}
# Rows of a table for which a shuffle starts with one more partition: what a task sorts or aggregates does not grow with the table.
ROWS_A_PARTITION = {"part": 10_000, "events": 50_000, "orders": 200_000, "lineitem": 200_000}

# name -> (views and tables it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, reads: list[str], sql: str) -> None:
    VIEWS[name] = (reads, sql.strip())


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name in seen or name not in VIEWS:
            continue
        _ordered(VIEWS[name][0], seen)
        seen.append(name)
    return seen


def _bases(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for read in VIEWS[name][0]:
            if read in BASE and read not in found:
                found.append(read)
    return found


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views and those they read, in SQL both engines run."""
    ordered = _ordered(list(names), [])
    return "WITH " + ",\n".join(f"{name} AS (\n{VIEWS[name][1]}\n)" for name in ordered)


class Tables:
    """The tables of one scale-factor folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._counts: dict[str, int] = {}
        join_by_measure(spark)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _rows(self, name: str) -> int:
        if name not in self._counts:
            self._counts[name] = self._read(name).count()
        return self._counts[name]

    def _spread(self, name: str) -> int:
        """Partitions to deal a table out to: as many as the session asks for, else one per so many rows of a narrow table, so that a task's
        share does not grow with the table. Tables of whole texts are read as they are split, and never shuffled before their first operator."""
        asked = int(self.spark.conf.get(SPREAD, "0"))
        if name in ROWS_A_TASK and not asked:
            tasks = -(-self._rows(name) // ROWS_A_TASK[name])
            return tasks if tasks > 1 else 0
        return asked if name in WIDE_ROWS else 0

    def _widen(self, name: str) -> None:
        if name in ROWS_A_PARTITION and not int(self.spark.conf.get(SPREAD, "0")):
            widen_shuffles(self.spark, -(-self._rows(name) // ROWS_A_PARTITION[name]))

    def base(self, name: str) -> DataFrame:
        self._widen(name)
        df = self._read(name)
        tasks = self._spread(name)
        return df.repartition(tasks) if tasks else df

    def _scan_sql(self, name: str) -> str:
        self._widen(name)
        tasks = self._spread(name)
        hint = f"/*+ REPARTITION({tasks}) */ " if tasks else ""
        return f"{name} AS (SELECT {hint}* FROM parquet.`{self.sf_dir}/{name}.parquet`)"

    def derived(self, name: str) -> DataFrame:
        ordered = _ordered([name], [])
        ctes = [self._scan_sql(base) for base in _bases(ordered)]
        ctes += [f"{part} AS (\n{VIEWS[part][1]}\n)" for part in ordered]
        return self.spark.sql("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name in VIEWS:
            return self.derived(name)
        raise AttributeError(name)


# ---- attempts and bench rows ------------------------------------------------
view("attempts", ["events"], """
SELECT concat('t', cast(event_id - event_id % 3 AS string)) AS trace_id,
       cast(event_id % 3 AS int) AS attempt_ordinal,
       ts AS observed_at,
       concat('site', cast((event_id - event_id % 3) % 20 AS string), '.example.com') AS domain,
       concat('/p/', cast((event_id - event_id % 3) AS string), '/x') AS path,
       CASE (user_id + event_id) % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'local' WHEN 2 THEN 'reader'
            WHEN 3 THEN 'stealth' ELSE 'paid' END AS provider,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'observed' END AS outcome,
       CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'CAPTCHA'
            WHEN event_id % 4 = 1 THEN 'BLOCKED' WHEN event_id % 4 = 2 THEN 'TIMEOUT' ELSE 'NOT_FOUND' END AS failure_code,
       value * 10 AS latency_ms,
       CASE WHEN (user_id + event_id) % 5 <> 4 THEN cast(0 AS double)
            WHEN event_id % 7 = 0 THEN NULL ELSE cast(0.005 AS double) END AS cost_usd,
       CASE user_id % 4 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'akamai' WHEN 2 THEN 'datadome' ELSE NULL END AS wall_vendor,
       event_id
FROM events
""")
# The journal adds legacy copies (no ordinal) of sign-up rows; half of those contradict the exact row they copy.
view("journal", ["attempts", "events"], """
SELECT a.trace_id, a.attempt_ordinal, a.observed_at, a.domain, a.path, a.provider, a.outcome, a.failure_code,
       a.latency_ms, a.event_id * 2 AS pos
FROM attempts a
UNION ALL
SELECT a.trace_id, cast(NULL AS int) AS attempt_ordinal, a.observed_at, a.domain, a.path, a.provider,
       CASE WHEN e.user_id % 2 = 0 THEN 'failed' ELSE a.outcome END AS outcome,
       CASE WHEN e.user_id % 2 = 0 THEN 'TIMEOUT' ELSE a.failure_code END AS failure_code,
       a.latency_ms, a.event_id * 2 + 1 AS pos
FROM attempts a JOIN events e ON e.event_id = a.event_id
WHERE e.event_type = 'signup'
""")
view("bench_rows", ["attempts", "events"], """
SELECT a.provider AS arm,
       concat('set', cast(e.user_id % 3 AS string)) AS set_name,
       concat('https://site', cast(e.user_id AS string), '.example.com/') AS url,
       CASE e.user_id % 4 WHEN 0 THEN 'shop' WHEN 1 THEN 'news' WHEN 2 THEN 'jobs' ELSE 'docs' END AS wall,
       CASE e.user_id % 5 WHEN 0 THEN 'listing' WHEN 1 THEN 'search' WHEN 2 THEN 'article' WHEN 3 THEN 'pdf'
            ELSE 'json' END AS kind,
       a.outcome AS status, a.outcome = 'observed' AND e.event_type <> 'signup' AS valid,
       CASE WHEN a.outcome = 'observed' AND e.event_type = 'signup' THEN
            CASE WHEN e.event_id % 2 = 0 THEN 'thin' ELSE 'expect_missing' END END AS invalid_reason,
       a.failure_code AS failure, a.latency_ms, a.cost_usd,
       cast(e.event_id * 37 % 5000 AS bigint) AS text_chars,
       cast(e.event_id * 13 % 9000 AS bigint) AS tokens,
       CASE e.event_id % 6 WHEN 0 THEN 'application/json' WHEN 1 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
       e.event_id AS pos
FROM events e JOIN attempts a ON a.event_id = e.event_id
""")

# ---- search hits: one query per order, one hit per line item -------------------
view("hits", ["lineitem", "part"], """
SELECT l.l_orderkey AS query_id,
       CASE l.l_returnflag WHEN 'A' THEN 'searxng' WHEN 'N' THEN 'wikipedia' ELSE 'github' END AS source,
       CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS source_pos,
       cast(l.l_linenumber AS bigint) AS rank,
       l.l_partkey AS item_id,
       CASE l.l_suppkey % 6
         WHEN 0 THEN concat('https://www.shop.example.com/p/', cast(l.l_orderkey AS string), '-', cast(cast(l.l_quantity AS bigint) % 2 AS string), '/?utm_source=feed')
         WHEN 1 THEN concat('http://shop.example.com/p/', cast(l.l_orderkey AS string), '-', cast(cast(l.l_quantity AS bigint) % 2 AS string))
         WHEN 2 THEN concat('https://news.example.org/2026/09/', cast(l.l_orderkey % 2 AS string), cast(1 + l.l_linenumber AS string), '/widget-prices-fall-again')
         WHEN 3 THEN concat('https://blog.example.net/tag/', CASE l.l_linestatus WHEN 'O' THEN 'gear' ELSE 'bolt' END)
         WHEN 4 THEN concat('https://github.com/acme/', CASE l.l_linestatus WHEN 'O' THEN 'gear' ELSE 'widget-demo' END)
         ELSE concat('https://example', cast(l.l_suppkey AS string), '.com/') END AS url,
       concat(CASE l.l_linestatus WHEN 'O' THEN 'Review: ' ELSE '' END, p.p_name,
              CASE WHEN l.l_discount > 0.08 THEN ' - Just a moment' WHEN l.l_tax > 0.07 THEN ' stock moves (GE) today' ELSE '' END) AS title,
       concat('All about the ', p.p_name, ' by ', p.p_brand) AS snippet,
       CASE WHEN l.l_tax < 0.02 THEN NULL ELSE l.l_shipdate END AS published,
       l.l_extendedprice AS extra_stars
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
""")
view("query_log", ["part"], """
SELECT p_partkey AS query_id,
       CASE p_partkey % 40
         WHEN 0 THEN concat('latest news this week on ', p_name) WHEN 1 THEN concat('how to fix a ', p_name)
         WHEN 2 THEN concat(p_name, ' review site:example.com -site:spam.com') WHEN 3 THEN 'news 2026 today'
         WHEN 4 THEN concat('paper on ', p_name) WHEN 5 THEN concat('arxiv ', p_name)
         WHEN 6 THEN concat(p_name, ' preprint') WHEN 7 THEN 'survey of vector databases'
         WHEN 8 THEN concat('Acme ', p_type, ' news') WHEN 9 THEN concat('latest on the ', p_name)
         WHEN 10 THEN 'Nvidia today' WHEN 11 THEN 'what happened with Tesla this week'
         WHEN 12 THEN 'who wrote Hamlet' WHEN 13 THEN concat('what is a ', p_name)
         WHEN 14 THEN 'how tall is Mount Everest' WHEN 15 THEN concat('population of ', p_type)
         WHEN 16 THEN 'how to reverse a list in python' WHEN 17 THEN 'TypeError: cannot read properties of undefined'
         WHEN 18 THEN 'fix segfault in my_function()' WHEN 19 THEN 'npm install fails with ERR_OSSL_EVP_UNSUPPORTED'
         WHEN 20 THEN 'public library for kids near me' WHEN 21 THEN 'Python the snake'
         WHEN 22 THEN concat('cheap flights to ', p_type) WHEN 23 THEN concat('Acme announces new ', p_name)
         WHEN 24 THEN 'OpenAI press release' WHEN 25 THEN 'how I wrote my first novel'
         WHEN 26 THEN concat('go library for ', p_name) WHEN 27 THEN 'httpx python github'
         WHEN 28 THEN 'python web framework' WHEN 29 THEN concat('Hugging Face ', p_name)
         WHEN 30 THEN 'Bank of America layoffs' WHEN 31 THEN 'weather in Sydney'
         WHEN 32 THEN 'Arm Holdings earnings' WHEN 33 THEN 'GE Aerospace official site'
         WHEN 34 THEN 'pricing at docs.example.com today' WHEN 35 THEN concat('read config.yaml for ', p_name)
         WHEN 36 THEN concat('best ', p_name, ' in 2026') WHEN 37 THEN 'who founded Samsung'
         WHEN 38 THEN concat('the ', p_name, ' and the ', p_type) ELSE p_name END AS query,
       CASE p_partkey % 3 WHEN 0 THEN 'week' WHEN 1 THEN 'month' ELSE NULL END AS recency
FROM part
""")

# ---- URLs of every shape the URL columns tell apart -------------------------------
view("urls", ["events", "pages"], """
SELECT event_id AS url_id,
       CASE event_id % 32
         WHEN 0 THEN concat('https://www.Shop', cast(user_id AS string), '.example.co.uk/search?q=blue+Lamps%20sale&utm_source=feed&page=', cast(event_id % 5 AS string))
         WHEN 1 THEN concat('http://shop.example.com/p/brass-desk-lamp-with-shade-', cast(100000 + event_id AS string), '#top')
         WHEN 2 THEN concat('https://news.example.org/2024/0', cast(1 + event_id % 9 AS string), '/1', cast(event_id % 10 AS string), '/big-story-about-things')
         WHEN 3 THEN 'https://www.example.com/en-us/index.html?ref=x'
         WHEN 4 THEN concat('https://blog.example.net/tag/t', cast(user_id AS string), '/')
         WHEN 5 THEN concat('https://api.example.com/a/b?token=abc&x=', cast(event_id AS string), '&api_key=zz&Session_ID=9#frag')
         WHEN 6 THEN concat('https://github.com/topics/t', cast(user_id AS string))
         WHEN 7 THEN concat('https://github.com/owner', cast(user_id AS string), '/name')
         WHEN 8 THEN concat('https://arxiv.org/abs/2410.0', cast(1000 + event_id % 9000 AS string), 'v2')
         WHEN 9 THEN concat('https://example.com/resources/guides/how-to-', event_type)
         WHEN 10 THEN concat('https://example.com/blog/tips/', event_type)
         WHEN 11 THEN concat('https://example.com/2026/sep/0915-', event_type, '-title')
         WHEN 12 THEN concat('https://example.com/news/202610', cast(10 + event_id % 20 AS string), '057924/', event_type)
         WHEN 13 THEN concat('https://example.com/news/', event_type, '?page=2&id=')
         WHEN 14 THEN 'https://example.com/news/press-release-archive/22'
         WHEN 15 THEN concat('https://example.com/docs/v1.', cast(user_id AS string), '/@scope/guide.html')
         WHEN 16 THEN concat('https://HELP.example.com:8080/help/faq?b=2&a=1&fbclid=', cast(event_id AS string))
         WHEN 17 THEN concat('https://example.com/story?id=', cast(event_id AS string), '&mc_cid=1&igshid=2')
         WHEN 18 THEN concat('https://ads.doubleclick.net/aclk?x=', cast(event_id AS string))
         WHEN 19 THEN concat('https://example.com/images/photo-', cast(event_id AS string), '.JPG')
         WHEN 20 THEN concat('https://example.com/press/', event_type, '-profits-rise-sharply/')
         WHEN 21 THEN concat('https://example.com/a/0123abcd-', cast(1000 + event_id % 9000 AS string), '-4444-8888-0123456789ab')
         WHEN 22 THEN 'https://example.com'
         WHEN 23 THEN concat('https://example.com/list?l=100&sort=price&ref_src=', event_type)
         WHEN 24 THEN concat('https://example.com/rooms/', cast(event_id AS string), '?taid=1&ocid=2&ref=3')
         WHEN 25 THEN concat('https://shop.example.com.au/jobs/', event_type, '-jobs?spm=1')
         WHEN 26 THEN concat('https://example.com/tag/', event_type, '?category=', cast(user_id AS string))
         WHEN 27 THEN concat('https://m.example.com/about_us/our-', event_type, '_team.php')
         WHEN 28 THEN concat('https://example.com/2019/13/45/', event_type)
         WHEN 29 THEN concat('https://example.com/2025/0', cast(1 + event_id % 9 AS string), '/')
         WHEN 30 THEN concat('https://example.com/find?query=red%20', event_type, '&sort=asc')
         ELSE concat('https://site', cast(user_id AS string), '.example.com/c/', event_type, '/item-', cast(event_id AS string)) END AS url
FROM events
UNION ALL
SELECT -1 - page_id AS url_id, url FROM pages
""")
view("host_pairs", ["events"], """
SELECT event_id AS pair_id,
       concat(CASE user_id % 2 WHEN 0 THEN 'www.' ELSE '' END, 'Site', cast(user_id AS string), '.example.com') AS base_host,
       CASE event_id % 8
         WHEN 0 THEN concat('site', cast(user_id AS string), '.example.com')
         WHEN 1 THEN concat('artist', cast(event_id AS string), '.site', cast(user_id AS string), '.example.com')
         WHEN 2 THEN concat('help.site', cast(user_id AS string), '.example.com')
         WHEN 3 THEN concat('shop.cdn.site', cast(user_id AS string), '.example.com')
         WHEN 4 THEN 'example.com'
         WHEN 5 THEN concat('notsite', cast(user_id AS string), '.example.com')
         WHEN 6 THEN concat('site', cast(user_id AS string), '.example.co.uk')
         ELSE '' END AS link_host
FROM events
""")

# ---- cards, listings and graphs ----------------------------------------------------
view("card_text", ["part"], """
SELECT p_partkey AS card_id, p_name AS title,
       concat(p_name, ' Was $', cast(cast(p_size * 3 + 20 AS int) AS string), '.50 now $', cast(cast(p_size * 2 + 10 AS int) AS string),
              CASE p_size % 4 WHEN 0 THEN ' In stock' WHEN 1 THEN ' Sold out' WHEN 2 THEN concat(' Only ', cast(p_size AS string), ' left')
                   ELSE ' Expired' END,
              CASE p_partkey % 3 WHEN 0 THEN concat(' 4.', cast(p_size % 10 AS string), ' out of 5') WHEN 1 THEN ' 3.5 stars' ELSE ' 0/5' END,
              ' (', cast(p_partkey AS string), ' reviews)',
              CASE p_partkey % 5 WHEN 0 THEN ' posted 3 days ago' WHEN 1 THEN ' 12 March 2027' ELSE '' END) AS body
FROM part
""")
view("listing_rows", ["lineitem"], """
SELECT l_suppkey AS chain_id, l_linenumber AS page_number, l_partkey AS listing_id, count(*) AS copies
FROM lineitem GROUP BY l_suppkey, l_linenumber, l_partkey
""")
# A site whose pages are its nations, suppliers, parts and orders, linked downwards (and home again).
view("site_links", ["nation", "supplier", "lineitem"], """
SELECT 'https://www.site.example.com/' AS src, concat('https://www.site.example.com/n/', cast(n_nationkey AS string)) AS dst FROM nation
UNION ALL
SELECT concat('https://www.site.example.com/n/', cast(s_nationkey AS string)), concat('https://www.site.example.com/s/', cast(s_suppkey AS string)) FROM supplier
UNION ALL
SELECT concat('https://www.site.example.com/s/', cast(l_suppkey AS string)),
       concat('https://www.site.example.com/', CASE WHEN l_partkey % 10 = 0 THEN 'private/' WHEN l_partkey % 10 = 1 THEN 'x/' ELSE 'p/' END, cast(l_partkey AS string),
              CASE WHEN l_partkey % 10 = 2 THEN '.jpg' ELSE '' END)
FROM lineitem GROUP BY l_suppkey, l_partkey
UNION ALL
SELECT concat('https://www.site.example.com/p/', cast(l_partkey AS string)), 'https://www.site.example.com/' FROM lineitem GROUP BY l_partkey
""")

# ---- text of every spelling the text columns tell apart ---------------------------------
view("number_text", ["events"], """
SELECT event_id,
       CASE event_id % 10
         WHEN 0 THEN concat('$', cast(1 + event_id % 9 AS string), ',', lpad(cast(event_id % 1000 AS string), 3, '0'), '.50')
         WHEN 1 THEN concat(cast(1 + event_id % 9 AS string), '.', lpad(cast(event_id % 1000 AS string), 3, '0'), ',99 EUR')
         WHEN 2 THEN concat(cast(event_id % 100 AS string), ',5')
         WHEN 3 THEN concat('1.', lpad(cast(event_id % 1000 AS string), 3, '0'), '.567')
         WHEN 4 THEN cast(event_id AS string)
         WHEN 5 THEN concat('-', cast(event_id % 50 AS string), '.25')
         WHEN 6 THEN 'n/a'
         WHEN 7 THEN concat('about ', cast(event_id % 7 AS string), ' of them')
         WHEN 8 THEN concat(cast(event_id % 900 AS string), ',', lpad(cast(event_id % 1000 AS string), 3, '0'))
         ELSE concat('AUD ', cast(event_id % 300 AS string)) END AS txt
FROM events
""")
view("date_text", ["events"], """
SELECT event_id,
       CASE event_id % 9
         WHEN 0 THEN concat('2024-01-', lpad(cast(1 + user_id % 28 AS string), 2, '0'), 'T03:04:05Z')
         WHEN 1 THEN concat('2024-02-', lpad(cast(1 + user_id % 28 AS string), 2, '0'))
         WHEN 2 THEN concat('Tue, ', lpad(cast(1 + user_id % 28 AS string), 2, '0'), ' Mar 2024 03:04:05 GMT')
         WHEN 3 THEN concat(cast(1 + user_id % 28 AS string), ' Apr 2024 13:14:00 +0200')
         WHEN 4 THEN cast(1700000000 + event_id AS string)
         WHEN 5 THEN 'yesterday'
         WHEN 6 THEN concat('2024-05-', lpad(cast(1 + user_id % 28 AS string), 2, '0'), ' 10:20:30')
         WHEN 7 THEN concat('2024-06-', lpad(cast(1 + user_id % 28 AS string), 2, '0'), 'T10:20:30+05:30')
         ELSE '2024-13-45' END AS txt,
       CASE event_id % 8
         WHEN 0 THEN concat(cast(1 + user_id % 9 AS string), ' days ago - a story') WHEN 1 THEN '2026-10-09 - Something happened'
         WHEN 2 THEN concat(cast(1 + user_id % 28 AS string), ' Sept 2026 - Something') WHEN 3 THEN concat('October ', cast(1 + user_id % 28 AS string), 'th, 2026 Something')
         WHEN 4 THEN concat('Dec ', cast(1 + user_id % 28 AS string), ' - Something') WHEN 5 THEN 'a week ago - text'
         WHEN 6 THEN 'Yesterday it rained' ELSE 'No date in this text' END AS snippet
FROM events
""")
view("responses", ["events"], """
SELECT event_id,
       CASE event_id % 14
         WHEN 0 THEN 'server=cloudflare;cf-ray=1' WHEN 1 THEN 'X-DataDome=1' WHEN 2 THEN 'set-cookie=_pxhd' WHEN 3 THEN 'x-kpsdk-ct=1'
         WHEN 4 THEN 'set-cookie=visid_incap_1' WHEN 5 THEN 'server=AkamaiGHost' WHEN 6 THEN 'x-amzn-waf-action=challenge'
         WHEN 7 THEN 'x-vercel-mitigated=deny' WHEN 8 THEN 'x-sucuri-id=7' WHEN 9 THEN 'server=nginx;set-cookie=datadome=1'
         ELSE 'server=nginx' END AS headers,
       CASE event_id % 11 WHEN 0 THEN 'Incapsula incident' WHEN 1 THEN 'see /cdn-cgi/challenge-platform' WHEN 2 THEN 'px-captcha'
         WHEN 3 THEN 'Vercel Security Checkpoint' ELSE 'hello' END AS body,
       CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 404 WHEN 5 THEN 410
         WHEN 6 THEN 418 WHEN 7 THEN 503 ELSE 301 END AS status
FROM events
""")
view("answers", ["conversations"], """
SELECT conv_id, turn,
       concat(text, CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), 'ANSWER: The Answer is ', cast(conv_id AS string))
              WHEN 2 THEN concat(chr(10), 'ANSWER: no', chr(10), 'ANSWER: 1,2', lpad(cast(conv_id % 100 AS string), 2, '0'), '.5 apples')
              WHEN 3 THEN concat(chr(10), 'ANSWER: code-', role) ELSE ' so ANSWER:   42  ' END) AS txt
FROM conversations
""")

# ---- markdown and product pages -----------------------------------------------------------
view("md_docs", ["documents"], """
SELECT doc_id,
       CASE doc_id % 5
         WHEN 0 THEN concat('Title: Page', chr(10), repeat(concat('[Category page](https://a.test/c)', chr(10)), 90), 'Sign in', chr(10), text)
         WHEN 1 THEN concat('# Head', chr(10), text, chr(10), 'Copyright 2026 Example Holdings Limited. All rights reserved by their owners.')
         WHEN 2 THEN concat('# Head', chr(10), '```', chr(10), text, chr(10), '```', chr(10), 'Home', chr(10), 'About us')
         WHEN 3 THEN concat(repeat(concat('[Story](https://a.test/s) more', chr(10)), 60), 'We use cookies to make this page work for everyone who reads it.', chr(10), text)
         ELSE text END AS content
FROM documents
""")
view("product_pages", ["part"], """
SELECT p_partkey AS page_id,
       concat('https://www.shop', cast(p_size AS string), '.example.com/product/', cast(p_partkey AS string), '-a-very-plain-', replace(p_name, ' ', '-'), '?ref=x') AS url,
       concat('<!DOCTYPE html><html><head><title>', p_name, ' | Shop ', cast(p_size AS string), '</title>',
              '<meta property="og:title" content="', p_name, ' by ', p_brand, '"><meta name="Description" content="A ', p_name, '.">',
              '<meta property="og:image" content="/img/', cast(p_partkey AS string), '.jpg">',
              CASE p_partkey % 3 WHEN 0 THEN concat('<meta property="article:published_time" content="2024-01-', lpad(cast(1 + p_size % 28 AS string), 2, '0'), 'T08:00:00Z">') ELSE '' END,
              '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="alternate" type="application/atom+xml" href="https://a.test/atom">',
              '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList","name":"Home"},{"@type":"Product","name":"', p_name,
              '","sku":"L-', cast(p_partkey AS string), '","brand":{"@type":"Brand","name":"', p_brand, '"},"image":["/img/', cast(p_partkey AS string), '.jpg"],"datePublished":"2024-02-',
              lpad(cast(1 + p_size % 28 AS string), 2, '0'), '","offers":{"@type":"Offer","price":"1,2', lpad(cast(p_size AS string), 2, '0'), '.50","priceCurrency":"AUD"},"aggregateRating":{"ratingValue":"4.',
              cast(p_size % 10 AS string), '","reviewCount":"', cast(p_partkey AS string), '"}}]}</script>',
              '<script type="application/json" id="__NEXT_DATA__">{"props":{"menu":[{"title":"Home","href":"/"},{"title":"All","href":"/all"},{"title":"New","href":"/new"}],"items":[',
              '{"name":"', p_name, ' one","url":"/product/1', cast(p_partkey AS string), '-x","price":', cast(p_size AS string), ',"id":1,"sku":"a","stock":3},',
              '{"name":"', p_name, ' two","url":"/product/2', cast(p_partkey AS string), '-x","price":', cast(p_size + 1 AS string), ',"id":2,"sku":"b","stock":0},',
              '{"name":"', p_name, ' three","url":"/product/3', cast(p_partkey AS string), '-x","price":', cast(p_size + 2 AS string), ',"id":3,"sku":"c","stock":9}]}}</script>',
              '</head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/c/', p_type, '">', p_type, '</a></li></ul></nav><main><article><h1>', p_name, '</h1>',
              '<p>The <b>', p_name, '</b> is made by ', p_brand, ' in size ', cast(p_size AS string), ', and it costs $', cast(p_size * 2 + 10 AS string), ' with <a href="/ship">shipping</a> included for every order over a long enough text to count as a paragraph of the page.</p>',
              '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">', p_name, '</span><span itemprop="price" content="1.2', lpad(cast(p_size AS string), 2, '0'), ',50">x</span></div>',
              '<a href="/product/1', cast(p_partkey AS string), '-a-very-plain-ring"><img src="/img/1', cast(p_partkey AS string), '.jpg" alt="', p_name, ' one"></a>',
              '<a href="/product/2', cast(p_partkey AS string), '-a-very-plain-ring" title="Two">', p_name, ' two</a>',
              '<time datetime="2024-03-', lpad(cast(1 + p_size % 28 AS string), 2, '0'), '">March</time>',
              '<ul><li>First point that is long enough</li><li>Second <em>point</em></li></ul><table><tr><th>Size</th><th>Brand</th></tr><tr><td>', cast(p_size AS string), '</td><td>', p_brand, '</td></tr></table>',
              '</article></main><footer>&copy; Shop &middot; All rights reserved</footer></body></html>') AS html
FROM part
""")
view("listing_md", ["part"], """
SELECT p_partkey AS page_id,
       concat('https://www.shop', cast(p_size AS string), '.example.com/listing/', cast(p_partkey AS string)) AS url,
       concat('# Shop ', cast(p_size AS string), chr(10), chr(10), '- [Category one](/c/1)', chr(10), '- [Category two](/c/2)', chr(10), '- [Category three](/c/3)', chr(10), chr(10),
         '[![', p_name, ' A](/img/', cast(p_partkey AS string), 'a.jpg)](/product/', cast(p_partkey AS string), 'a)', chr(10), '[', p_name, ' A](/product/', cast(p_partkey AS string), 'a)', chr(10), '$', cast(p_size + 20 AS string), chr(10), 'Save $5!', chr(10), '$', cast(p_size + 15 AS string), chr(10), 'in stock', chr(10),
         '[', p_name, ' B](/product/', cast(p_partkey AS string), 'b)', chr(10), '$', cast(p_size + 30 AS string), chr(10), 'SOLD OUT', chr(10),
         '[', p_name, ' C](/product/', cast(p_partkey AS string), 'c)', chr(10), '$', cast(p_size + 40 AS string), chr(10), 'Only 3 left', chr(10), 'Posted 3 days ago', chr(10),
         '[', p_name, ' D](/product/', cast(p_partkey AS string), 'd)', chr(10), '$', cast(p_size + 50 AS string), chr(10), '4.5 out of 5 (12 reviews)', chr(10),
         '[Privacy](/privacy) [Contact](/contact)', chr(10)) AS content
FROM part
""")
view("shop_json", ["part"], """
SELECT p_partkey AS page_id, concat('https://shop', cast(p_size AS string), '.example.com/en-au/collections/', replace(p_name, ' ', '-')) AS url,
       concat('{"products":[{"title":"', p_name, '  one","handle":"h1-', cast(p_partkey AS string), '","variants":[{"price":"', cast(p_size + 5 AS string), '.00","compare_at_price":"', cast(p_size + 9 AS string),
         '.00","available":false},{"price":"', cast(p_size + 7 AS string), '.50","compare_at_price":"', cast(p_size + 3 AS string), '.00","available":', CASE p_partkey % 2 WHEN 0 THEN 'true' ELSE 'false' END,
         '}],"images":[{"src":"https://i.test/1.jpg"}]},{"title":"', p_name, ' two","handle":"h2-', cast(p_partkey AS string), '","variants":[{"price":"9.99","compare_at_price":null}],"images":[]}]}') AS body,
       CASE p_partkey % 3 WHEN 0 THEN '<script>Shopify.shop = 1</script>' WHEN 1 THEN '<img src="//cdn.shopify.com/s/files/1"><img src="//cdn.shopify.com/s/files/2"><img src="/cdn/shop/files/3">' ELSE '<p>plain</p>' END AS html
FROM part
""")
# Reads that came back as pages, walls, login forms and error pages.
view("reads", ["events"], """
SELECT event_id, concat('https://www.site', cast(user_id AS string), '.example.com/p/', cast(event_id AS string)) AS requested_url,
       CASE event_id % 13 WHEN 0 THEN concat('https://www.site', cast(user_id AS string), '.example.com/') WHEN 1 THEN 'https://login.example.com/signin'
         WHEN 2 THEN concat('https://www.site', cast(user_id AS string), '.example.com/captcha') WHEN 3 THEN concat('https://www.site', cast(user_id AS string), '.example.com/error/404')
         ELSE concat('https://www.site', cast(user_id AS string), '.example.com/p/', cast(event_id AS string)) END AS final_url,
       CASE event_id % 11 WHEN 0 THEN 'Site - Access denied' WHEN 1 THEN 'Just a moment...' WHEN 2 THEN '# Page not found | Shop' WHEN 3 THEN 'Log in to Site'
         WHEN 4 THEN concat('site', cast(user_id AS string)) WHEN 5 THEN 'Error' ELSE concat('Item ', cast(event_id AS string)) END AS title,
       concat(CASE event_id % 17 WHEN 0 THEN 'Please verify you are a human. ' WHEN 1 THEN 'ERR_CONNECTION_REFUSED ' WHEN 2 THEN 'The site is down for maintenance. '
           WHEN 3 THEN 'Please sign in to read. ' WHEN 4 THEN 'Enter your password to log in. ' WHEN 5 THEN 'This page doesn''t exist here. ' WHEN 6 THEN 'Price $0.00 '
           WHEN 7 THEN '{{ item.name }} NaN undefined {{x}} ' WHEN 8 THEN 'Subscribe to continue reading. ' WHEN 9 THEN 'Select a date to see prices. '
           WHEN 10 THEN 'No products found in this store. ' WHEN 11 THEN 'Cookies: we use cookies, cookie consent. ' WHEN 12 THEN '' ELSE 'Only $15.50 today. ' END,
         CASE WHEN event_id % 17 = 12 THEN '' ELSE repeat(concat(event_type, ' words of the page go on. '), cast(event_id % 150 AS int)) END) AS body
FROM events
""")
view("journal_full", ["journal"], """
SELECT j.trace_id, j.attempt_ordinal, j.observed_at, j.domain, '/p/{number}/x' AS path_pattern, 'read' AS operation, cast(NULL AS string) AS adapter,
       cast(NULL AS string) AS adapter_version, cast(NULL AS string) AS adapter_binding_id, 'public' AS identity_class, repeat('c', 64) AS acquisition_context,
       j.provider, '1' AS provider_version, repeat('a', 64) AS provider_binding_id, j.outcome, j.failure_code, j.latency_ms, j.pos
FROM journal j
""")
view("verifications", ["attempts", "events"], """
SELECT a.trace_id, a.provider, '1' AS provider_version, repeat('a', 64) AS provider_binding_id, 'read' AS operation, cast(NULL AS string) AS adapter,
       cast(NULL AS string) AS adapter_version, cast(NULL AS string) AS adapter_binding_id, repeat('c', 64) AS acquisition_context, a.observed_at, a.attempt_ordinal
FROM attempts a JOIN events e ON e.event_id = a.event_id WHERE e.event_type IN ('view', 'click')
""")
view("hit_queries", ["orders"], """
SELECT o_orderkey AS query_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'red widget' WHEN 1 THEN 'latest news on gears' WHEN 2 THEN 'acme gear github' WHEN 3 THEN 'widget stock price today'
         WHEN 4 THEN 'Acme announcement about a bolt' WHEN 5 THEN 'paper on ring gear' WHEN 6 THEN 'python library for rings' ELSE 'Example' END AS query,
       CASE o_orderkey % 3 WHEN 0 THEN 'year' ELSE NULL END AS recency
FROM orders
""")
