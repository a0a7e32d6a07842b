"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Receipts are derived from orders (``sources.adapter``) in Spark and, by the statements below, in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipwright import patterns as P
from slipwright.functions import labels as L
from slipwright.functions import money as M
from slipwright.functions import names as N
from slipwright.operators import layout
from slipwright.plans import accuracy as C
from slipwright.plans.storage import at_once, stored, stored_together
from slipwright.sources import adapter as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- SQL for the adapter --------------------------------------------------------------------------------------------

_NAME = "p_name"
for _word, _hangul in A.WORDS.items():
    _NAME = f"replace({_NAME}, '{_word}', '{_hangul}')"
_LABELS = "[" + ", ".join("'" + x + "'" for x in A.LABELS) + "]"

ITEMS = f"""items AS (
  SELECT rid, item_no, name, quantity, price, CASE WHEN (rid + item_no) % 3 = 0 THEN CAST(floor(price * l_discount) AS BIGINT) ELSE 0 END AS discount
  FROM (SELECT l_orderkey AS rid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS item_no,
               replace({_NAME}, ' ', '') AS name, CAST(l_quantity AS INT) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_discount
        FROM lineitem JOIN part ON l_partkey = p_partkey)),
totals AS (SELECT rid, max(item_no) AS n, CASE WHEN rid % 5 = 0 THEN 3000 ELSE 0 END AS fee,
                  CAST(sum(price - discount) + CASE WHEN rid % 5 = 0 THEN 3000 ELSE 0 END + CASE WHEN rid % 19 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS printed_total FROM items GROUP BY rid),
labelled AS (SELECT rid, item_no, {_LABELS}[1 + (rid * 7 + item_no) % {len(A.LABELS)}] AS label, price FROM items)"""

OCR = ITEMS + """,
boxes AS (
  SELECT rid, 10 * item_no + 1 AS line_no, CASE WHEN (rid * 3 + item_no) % 7 = 0 AND item_no > 1 THEN '+' || name ELSE name END AS text, 0.7 + ((rid * 7 + item_no * 13) % 30) / 100 AS confidence, 100 AS x1, 100 + 50 * item_no AS y1 FROM items
  UNION ALL SELECT rid, 10 * item_no + 2, CAST(quantity AS VARCHAR), 0.95, 400, 102 + 50 * item_no FROM items
  UNION ALL SELECT rid, 10 * item_no + 3, CASE WHEN (rid + item_no) % 11 = 0 THEN replace(format('{:,}', price), ',', '.') ELSE format('{:,}', price) END, 0.95, 600, 98 + 50 * item_no FROM items
  UNION ALL SELECT rid, 10 * item_no + 4, '행사할인', 0.95, 100, 125 + 50 * item_no FROM items WHERE discount > 0
  UNION ALL SELECT rid, 10 * item_no + 5, '-' || format('{:,}', discount), 0.95, 600, 125 + 50 * item_no FROM items WHERE discount > 0
  UNION ALL SELECT rid, 1, '상품명', 0.95, 100, 100 FROM totals UNION ALL SELECT rid, 2, '수량', 0.95, 400, 102 FROM totals UNION ALL SELECT rid, 3, '금액', 0.95, 600, 98 FROM totals
  UNION ALL SELECT rid, 10 * n + 11, '배달팁', 0.95, 100, 150 + 50 * n FROM totals WHERE fee > 0
  UNION ALL SELECT rid, 10 * n + 12, format('{:,}', fee), 0.95, 600, 150 + 50 * n FROM totals WHERE fee > 0
  UNION ALL SELECT rid, 10 * n + 21, '합계', 0.95, 100, 200 + 50 * n FROM totals UNION ALL SELECT rid, 10 * n + 22, format('{:,}', printed_total), 0.95, 600, 200 + 50 * n FROM totals
  UNION ALL SELECT rid, 10 * n + 31, '결제금액', 0.95, 100, 250 + 50 * n FROM totals UNION ALL SELECT rid, 10 * n + 32, format('{:,}', printed_total), 0.95, 600, 250 + 50 * n FROM totals),
ocr AS (SELECT rid, CAST(line_no AS INT) AS line_no, text, CAST(confidence AS DOUBLE) AS confidence, x1, CAST(y1 AS INT) AS y1, CAST(x1 + greatest(20, 20 * length(text)) AS INT) AS x2, CAST(y1 + 30 AS INT) AS y2 FROM boxes)"""

#: In the derived receipts rows lie at least 20 px apart, so a gap rule finds the same rows.
ROWS = OCR + """,
gaps AS (SELECT *, (y1 + y2) / 2.0 AS y, CASE WHEN (y1 + y2) / 2.0 - lag((y1 + y2) / 2.0) OVER w >= 18 THEN 1 ELSE 0 END AS opens FROM ocr WINDOW w AS (PARTITION BY rid ORDER BY (y1 + y2) / 2.0, line_no)),
tok AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY rid ORDER BY y, line_no ROWS UNBOUNDED PRECEDING) AS INT) AS row_no,
        CASE WHEN regexp_matches(text, '^-?₩?[0-9]{1,3}(?:,[0-9]{3})+원?$|^-?₩?[0-9]{3,7}원?$') AND NOT regexp_matches(text, '^[0-9]{8,}$') THEN CAST(regexp_replace(text, '[,₩원]', '', 'g') AS BIGINT) END AS amount FROM gaps),
rws AS (SELECT rid, row_no, CAST(min(x1) AS DOUBLE) AS x1, avg(y) AS y_center, string_agg(text, ' ' ORDER BY x1) AS text, replace(string_agg(text, '' ORDER BY x1), ' ', '') AS compact FROM tok GROUP BY rid, row_no)"""

PARSED = ROWS + """,
priced AS (SELECT *, max(CASE WHEN amount IS NOT NULL THEN x1 END) OVER (PARTITION BY rid, row_no) AS price_x FROM tok),
parsed AS (SELECT r.rid, r.row_no, r.x1, r.text, r.compact, p.price, p.quantity, p.name, p.name_conf FROM rws r JOIN (
  SELECT rid, row_no, max(CASE WHEN x1 = price_x THEN amount END) AS price,
         max_by(TRY_CAST(text AS INT), x1) FILTER (x1 IS DISTINCT FROM price_x AND regexp_matches(text, '^[0-9]{1,3}$') AND TRY_CAST(text AS INT) BETWEEN 1 AND 999) AS quantity,
         string_agg(text, ' ' ORDER BY x1) FILTER (regexp_matches(text, '[가-힣]') AND x1 IS DISTINCT FROM price_x) AS name,
         coalesce(min(confidence) FILTER (regexp_matches(text, '[가-힣]') AND x1 IS DISTINCT FROM price_x), 1.0) AS name_conf FROM priced GROUP BY rid, row_no) p USING (rid, row_no)),
region AS (SELECT rid, f AS first, coalesce(min(CASE WHEN row_no >= f AND regexp_matches(compact, '소계|합계|과세물품|면세물품|부가세|가액|공급가|봉사료|총구매|총액|주문금액|배달비|총결제|결제금액') THEN row_no END), CAST(count(*) AS INT)) AS last
  FROM (SELECT *, coalesce(min(CASE WHEN regexp_matches(text, '상\\s*품\\s*명|품\\s*명|메\\s*뉴') AND regexp_matches(text, '수\\s*량|단\\s*가|금\\s*액') THEN row_no + 1 END) OVER (PARTITION BY rid), 0) AS f FROM rws) GROUP BY rid, f)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_rows(layout.tokens(A.ocr_lines(spark, sf_dir)))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parse_rows(_rows(spark, sf_dir))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = stored(layout.tokens(A.ocr_lines(spark, sf_dir)), "tokens")  # read by rows and widths
    return layout.assemble(layout.parse_rows(layout.group_rows(boxed)), layout.char_widths(boxed))


# -- balance: the flagship slice ------------------------------------------------------------------------------------


@query(f"""WITH {ITEMS} SELECT o_orderkey AS rid, t.printed_total AS total_amount, CAST(coalesce(sum(i.price - i.discount), 0) + coalesce(t.fee, 0) AS BIGINT) AS computed,
  coalesce(t.printed_total = CAST(coalesce(sum(i.price - i.discount), 0) + coalesce(t.fee, 0) AS BIGINT), false) AND coalesce(bool_and(i.price - i.discount > 0), false) AS items_verified
  FROM orders LEFT JOIN items i ON i.rid = o_orderkey LEFT JOIN totals t ON t.rid = o_orderkey GROUP BY o_orderkey, t.printed_total, t.fee""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which receipts balance: the items' line totals and the fee against the printed total."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rid"))
    line = M.line_total(F.col("price"), F.lit(None), F.col("discount"))
    sums = A.items(spark, sf_dir).groupBy("rid").agg(F.sum(line).alias("items"), F.bool_and(line > 0).alias("positive"))
    rows = orders.join(sums, "rid", "left").join(A.totals(spark, sf_dir).select("rid", "fee", "printed_total"), "rid", "left")
    computed = F.coalesce("items", F.lit(0)) + F.coalesce("fee", F.lit(0))
    verified = F.coalesce(F.col("printed_total") == computed, F.lit(False)) & F.coalesce("positive", F.lit(False))
    return rows.select("rid", F.col("printed_total").alias("total_amount"), computed.cast("bigint").alias("computed"), verified.alias("items_verified"))


@query(f"WITH {ITEMS} SELECT rid, CAST(sum(price - discount) AS BIGINT) AS total, count(*) AS n_items FROM items GROUP BY rid")
def computed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = M.line_total(F.col("price"), F.lit(None), F.col("discount"))
    return A.items(spark, sf_dir).groupBy("rid").agg(F.sum(line).alias("total"), F.count("*").alias("n_items"))


# -- scalar functions over printed texts ----------------------------------------------------------------------------


@query(f"WITH {OCR} SELECT rid, line_no, text, CASE WHEN regexp_matches(text, '^-?₩?[0-9]{{1,3}}(?:,[0-9]{{3}})+원?$|^-?₩?[0-9]{{3,7}}원?$') AND NOT regexp_matches(text, '^[0-9]{{8,}}$') THEN CAST(regexp_replace(text, '[,₩원]', '', 'g') AS BIGINT) END AS won FROM ocr")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ocr_lines(spark, sf_dir).select("rid", "line_no", "text", M.money_value(F.col("text")).alias("won"))


# each derived text is one literal, so the look-around of the pattern is a full match here
@query(f"""WITH {OCR} SELECT rid, line_no, CASE WHEN regexp_full_match(text, '-?[0-9]{{1,3}}([,.][0-9]{{3}})+') THEN CAST(regexp_replace(text, '[^0-9-]', '', 'g') AS BIGINT) END AS first_amount,
  CASE WHEN regexp_full_match(text, '-?[0-9]{{1,3}}([,.][0-9]{{3}})+') THEN 1 ELSE 0 END AS n FROM ocr""")
def fuzzy_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.fuzzy_amounts(F.col("text"))
    return A.ocr_lines(spark, sf_dir).select("rid", "line_no", F.get(found, 0).alias("first_amount"), F.size(found).alias("n"))


@query(f"WITH {OCR} SELECT rid, CAST(number AS BIGINT) AS number FROM (SELECT DISTINCT rid, CAST(replace(unnest(regexp_extract_all(text, '[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+')), ',', '') AS BIGINT) AS number FROM ocr)")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ocr_lines(spark, sf_dir).select("rid", F.explode(M.numbers_in(F.col("text"))).alias("number")).distinct()


_KEY = "regexp_replace(label, '\\s+', '', 'g')"
_HANGUL = "regexp_replace(label, '[^가-힣]', '', 'g')"
_LEVEL = f"""CASE WHEN regexp_matches(trim(label), '(부가|과세|면세|공급|합.?계|결제|지불|이체|잔액|포인트|승인|일시불|개월|번호|청구|받을|받은|내실|거스름|VAT)[^:：]{{0,6}}[:：]|[:：].{{0,8}}(카드|은행|페이|일시불)')
  OR regexp_matches(label, '(^|[^A-Za-z])VAT([^A-Za-z]|$)')
  OR regexp_matches({_HANGUL}, '부가세|부가가치세|과세물품|면세물품|과세물|면세물|공급가액|총상품금액|상품금액|주문금액|주무금액|결제금액|카드결제|간편결제|카드지불|신용카드|계좌이체|현재잔액|거스름|승인번호|승인금액|일시불|주문번호|청구금액|받을금액|받은금액|내실금액|쿠팡캐시|소계금액|합계금액|적립포인트|받은포인트|할인합계')
  OR regexp_full_match({_HANGUL}, '(받은|적립|사용|보유|잔여|가용)?포인트|과세|면세|부세|가세|부가|합.{{0,2}}계.?|총액|소계|합계|공급가') THEN 2
  WHEN regexp_matches({_HANGUL}, '합계|결제|지불|이체|잔액|할부|포인트|카드|금액$|캐시|현금') THEN 1 ELSE 0 END"""


@query(f"WITH {ITEMS} SELECT rid, item_no, label, {_LEVEL} AS level FROM labelled")
def label_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).select("rid", "item_no", "label", L.label_level(F.col("label")).alias("level"))


@query(f"""WITH {ITEMS} SELECT rid, item_no, label, CASE WHEN price <> 0 AND regexp_matches({_KEY}, '할인|말인|합인|에누리|에누ㄹ|쿠폰|특매|D/?C') AND NOT regexp_matches({_KEY}, '현재잔액|잔액|배달팁|배달비|배달료|배달요금|배송비|무료배달|바코드|이용권')
  THEN CASE WHEN regexp_matches({_KEY}, '할인금액|합인금액|총할인|할인계|할인액|에누리계|할인\\(에누리\\)|쿠폰할인|쿠폰말인|할인쿠폰') THEN 'total' ELSE 'item' END END AS kind FROM labelled""")
def discount_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).select("rid", "item_no", "label", L.discount_kind(F.col("label"), F.col("price")).alias("kind"))


_FEE = "(배달(비|팁|료|요금)|배송비|무료배달)"


@query(f"""WITH {ITEMS}, k AS (SELECT *, {_KEY} AS key, regexp_replace({_KEY}, '^[^가-힣]+', '') AS core FROM labelled),
  t AS (SELECT *, regexp_matches(core, '^{_FEE}') AS starts, regexp_replace(core, '^{_FEE}', '') AS tail FROM k)
  SELECT rid, item_no, label, CASE WHEN regexp_matches(key, '{_FEE}(할인|무료|쿠폰)*(\\([^)]{{0,12}}\\))?[:：]?$')
    OR (starts AND NOT regexp_matches(regexp_replace(regexp_replace(regexp_replace(tail, '\\([^)]*\\)', '', 'g'), '[0-9][0-9,.]*원?', '', 'g'), '기본|합계|할증|추가|거리|할인|무료|쿠폰|포함|금액', '', 'g'), '[가-힣]'))
    THEN CASE WHEN regexp_matches(key, '할인|쿠폰|무료') THEN 'off' WHEN starts AND NOT regexp_matches(tail, '기본|할증|추가|거리') THEN 'parent' ELSE 'child' END END AS kind FROM t""")
def fee_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).select("rid", "item_no", "label", L.fee_label(F.col("label")).alias("kind"))


@query(f"WITH {ITEMS} SELECT rid, item_no, {_HANGUL} AS key FROM labelled")
def hangul_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).select("rid", "item_no", L.hangul(F.col("label")).alias("key"))


@query(f"WITH {ITEMS} SELECT rid, item_no, ({_LEVEL}) > 0 OR regexp_matches({_HANGUL}, '상품명|품명|메뉴|수량|단가|금액|배달|배송|결제|할인|쿠폰|적립|영수|합계|소계|총액|거래|매출|사업자|전화') AS non_item FROM labelled")
def non_item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).select("rid", "item_no", L.non_item(F.col("label")).alias("non_item"))


@query(f"""WITH {ITEMS} SELECT rid, item_no, regexp_matches(label, '^[-*+└ㄴ>›»▶►▸~]|^\\((추가|선택|변경|더하기)|^옵션') AS marked, regexp_matches(label, '^[+└ㄴ>›»▶►▸]') AS strong,
  regexp_replace(label, '^[-*+└ㄴ>›»▶►▸~\\s]+', '') AS bare FROM labelled""")
def option_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("label")
    return A.labelled(spark, sf_dir).select("rid", "item_no", L.marked(name).alias("marked"), L.strongly_marked(name).alias("strong"), L.without_marks(name).alias("bare"))


# no label is a number alone, so the look-ahead of the pattern always holds here
@query(f"WITH {ITEMS} SELECT rid, item_no, CASE WHEN regexp_matches(label, '^[0-9]{{1,3}}\\s*[*.)\\-]*\\s*[^0-9\\s]') THEN regexp_replace(label, '^[0-9]{{1,3}}\\s*[*.)\\-]*\\s*', '') ELSE label END AS name FROM labelled")
def line_numbers_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).select("rid", "item_no", L.without_line_number(F.col("label")).alias("name"))


@query(f"WITH {ITEMS} SELECT rid, item_no, label FROM labelled WHERE NOT regexp_matches(trim(label), '^(면세|과세)\\s*물품\\s*가액$|^부\\s*가\\s*세$|^소\\s*계$|^합\\s*계$|^할인|^봉사료$|^공급가액$')")
def summary_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(spark, sf_dir).filter(~L.summary_line(F.col("label"))).select("rid", "item_no", "label")


@query(f"""WITH {ITEMS}, p AS (SELECT DISTINCT printed_total AS total FROM totals), v AS (SELECT total, unnest([CAST(floor(total / 11) AS BIGINT), CAST(ceil(total / 11) AS BIGINT), CAST(round_even(total / 11, 0) AS BIGINT)]) AS tax FROM p)
  SELECT DISTINCT total, unnest([tax, total - tax]) AS part FROM v""")
def tax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = A.totals(spark, sf_dir).select(F.col("printed_total").alias("total")).distinct()
    return totals.select("total", F.explode(M.tax_split(F.col("total"))).alias("part"))


# -- layout ---------------------------------------------------------------------------------------------------------


@query(f"WITH {OCR} SELECT * FROM ocr")
def ocr_lines_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ocr_lines(spark, sf_dir)


@query(f"WITH {OCR} SELECT rid, line_no, text FROM ocr WHERE confidence >= 0.8")
def confident_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ocr_lines(spark, sf_dir).filter(F.col("confidence") >= 0.8).select("rid", "line_no", "text")


@query(f"WITH {OCR} SELECT rid, line_no, text, confidence, CAST(x1 AS DOUBLE) AS x1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 - y1 AS DOUBLE) AS height, CAST((y1 + y2) / 2.0 AS DOUBLE) AS y FROM ocr")
def boxed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tokens(A.ocr_lines(spark, sf_dir))


@query(f"WITH {ROWS} SELECT rid, row_no, x1, CAST(y_center AS DOUBLE) AS y_center, text, compact FROM rws")
def rows_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).drop("tokens")


@query(f"WITH {PARSED} SELECT rid, first, last FROM region")
def item_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.item_region(_rows(spark, sf_dir))


@query(f"WITH {PARSED} SELECT rid, row_no, price, quantity, name, CAST(name_conf AS DOUBLE) AS name_conf FROM parsed")
def row_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("rid", "row_no", "price", "quantity", "name", "name_conf")


@query(f"WITH {ROWS} SELECT rid, row_no, amount, CAST(count(*) AS INT) AS n FROM tok WHERE amount IS NOT NULL GROUP BY ALL")
def row_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("rid", "row_no", F.explode(M.row_amounts(F.col("tokens"))).alias("amount")).groupBy("rid", "row_no", "amount").agg(F.count("*").cast("int").alias("n"))


@query(f"WITH {ROWS} SELECT rid, row_no, amount, CAST(count(*) AS INT) AS n FROM tok WHERE amount IS NOT NULL AND regexp_matches(text, '[,₩원]') GROUP BY ALL")
def formatted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("rid", "row_no", F.explode(M.formatted_amounts(F.col("tokens"))).alias("amount")).groupBy("rid", "row_no", "amount").agg(F.count("*").cast("int").alias("n"))


@query(f"WITH {OCR} SELECT rid, CAST(coalesce(median(CASE WHEN regexp_matches(text, '[가-힣]') THEN (x2 - x1) / length(text) END), 1.0) AS DOUBLE) AS char_width FROM ocr GROUP BY rid")
def char_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.char_widths(layout.tokens(A.ocr_lines(spark, sf_dir)))


@query(f"""WITH {PARSED}, u AS (SELECT *, regexp_matches(compact, '합계|총액|총구매|총결제|결제금액|받을금액|선결제') AS s FROM parsed WHERE NOT regexp_matches(compact, '포인트|상품권|캐시|기프트|마일리지|예치금')),
  f AS (SELECT rid, coalesce(max_by(price, row_no) FILTER (s AND price > 0), min_by(price, row_no) FILTER (s AND price IS NOT NULL)) AS s,
               coalesce(max_by(price, row_no) FILTER (NOT s AND compact LIKE '%주문금액%' AND price > 0), NULL) AS w FROM u GROUP BY rid)
  SELECT rid, coalesce(s, w) AS total_amount, s IS NULL AND w IS NOT NULL AS total_is_weak FROM f""")
def total_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.total_label(_parsed(spark, sf_dir))


@query(f"""WITH {PARSED}, g AS (SELECT rid, row_no, price, name, count(*) OVER w AS n, sum(abs(price)) OVER w AS s FROM parsed WHERE price < 0 WINDOW w AS (PARTITION BY rid ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT rid, row_no, price, coalesce(n > 0 AND abs(price) = s AND (n >= 2 OR name IS NOT NULL), false) AS restated FROM g""")
def restated_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.restated(_parsed(spark, sf_dir))


@query(f"""WITH {PARSED}, s AS (SELECT *, lead(price) OVER w AS p1, lead(name) OVER w AS n1 FROM parsed WINDOW w AS (PARTITION BY rid ORDER BY row_no))
  SELECT rid, CAST(greatest(0, sum(DISTINCT price + CASE WHEN n1 IS NULL AND p1 < 0 THEN p1 ELSE 0 END)) AS BIGINT) AS delivery_fee FROM s WHERE name = '배달팁' AND price IS NOT NULL GROUP BY rid""")
def delivery_fee_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.delivery_fee(_parsed(spark, sf_dir))


# in the derived receipts options are marked, and every discount has its label
@query(f"""WITH {PARSED}, r AS (SELECT p.* FROM parsed p JOIN region g USING (rid) WHERE row_no >= first AND row_no < last),
  k AS (SELECT *, regexp_matches(compact, '배달팁') AS fee, name LIKE '+%' AS opt, price < 0 AS neg,
        coalesce(sum(CASE WHEN price < 0 THEN -price END) OVER b, 0) AS cuts, count(CASE WHEN price < 0 THEN 1 END) OVER b AS n_cuts FROM r WINDOW b AS (PARTITION BY rid ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  i AS (SELECT *, NOT fee AND NOT coalesce(neg, false) AND NOT opt AND price IS NOT NULL AS item FROM k),
  o AS (SELECT *, count(CASE WHEN item THEN 1 END) OVER (PARTITION BY rid ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS item_id FROM i)
  SELECT rid, row_no, item_id, CASE WHEN fee THEN 'fee' WHEN neg AND n_cuts > 0 AND cuts = -price THEN 'summary_discount' WHEN neg THEN CASE WHEN item_id > 0 THEN 'item_discount' ELSE 'summary_discount' END
    WHEN opt THEN CASE WHEN item_id > 0 THEN 'option' ELSE 'orphan_option' END WHEN item THEN 'item' ELSE 'name' END AS role FROM o""")
def item_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).select("rid", "row_no", "item_id", "role")


@query()
def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their discounts and options."""
    return layout.layout_items(_assembled(spark, sf_dir))


@query(f"""WITH {PARSED}, a AS (SELECT p.rid, p.row_no, p.price, coalesce(sum(-p.price) OVER b, 0) AS cuts, count(*) OVER b AS n_cuts FROM parsed p JOIN region g USING (rid) WHERE row_no >= first AND row_no < last AND price < 0
    WINDOW b AS (PARTITION BY rid ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT a.*, (n_cuts > 0 AND cuts = -price) OR NOT EXISTS (SELECT 1 FROM parsed q JOIN region g USING (rid) WHERE q.rid = a.rid AND q.row_no < a.row_no AND q.row_no >= g.first AND q.price > 0 AND q.name NOT LIKE '+%') AS summary FROM a)
  SELECT rid, CAST(coalesce(sum(CASE WHEN summary THEN -price END), 0) AS BIGINT) AS summary_discount, CAST(greatest(0, coalesce(sum(CASE WHEN summary THEN -price END), 0) - coalesce(sum(CASE WHEN NOT summary THEN -price END), 0)) AS BIGINT) AS discount FROM s GROUP BY rid""")
def receipt_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = stored(layout.tokens(A.ocr_lines(spark, sf_dir)), "tokens")
    rows = stored(layout.parse_rows(layout.group_rows(boxed)).drop("tokens"), "rows")  # read inside the region and behind it
    return layout.receipt_discount(layout.assemble(rows, layout.char_widths(boxed)), rows)


# -- names ----------------------------------------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT DISTINCT a.name AS a, b.name AS b FROM items a JOIN items b ON a.rid = b.rid)"""


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each name with all names of the receipts it stands on."""
    names = stored(A.items(spark, sf_dir).select("rid", "name").distinct(), "names")
    return names.withColumnRenamed("name", "a").join(names.withColumnRenamed("name", "b"), "rid").select("a", "b").distinct()


#: Letters as ASCII, since DuckDB's levenshtein counts bytes; first and last consonants share theirs.
_ASCII = {c: chr(48 + k) for k, c in enumerate(sorted(set(P.ONSETS + P.VOWELS + P.CODAS)))}
_TABLES = ["'" + "".join(_ASCII[c] for c in t) + "'" for t in (P.ONSETS, P.VOWELS, P.CODAS)]
_CODE = "(unicode(c) - 44032)"
SPELL = f"list_reduce(list_transform(string_split({{0}}, ''), lambda c: substr({_TABLES[0]}, CAST({_CODE} // 588 + 1 AS BIGINT), 1) || substr({_TABLES[1]}, CAST({_CODE} % 588 // 28 + 1 AS BIGINT), 1) || substr({_TABLES[2]}, CAST({_CODE} % 28 + 1 AS BIGINT), 1)), lambda x, y: x || y)"


@query(f"WITH {ITEMS}, {_PAIRS} SELECT a, b, CAST(levenshtein({SPELL.format('a')}, {SPELL.format('b')}) AS INT) AS distance FROM pairs")
def jamo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", N.letter_distance(F.col("a"), F.col("b")).alias("distance"))


@query(f"""WITH {ITEMS}, {_PAIRS}, d AS (SELECT a, b, levenshtein({SPELL.format('a')}, {SPELL.format('b')}) AS d FROM pairs)
  SELECT a, b, contains(a, b) OR contains(b, a) OR d <= greatest(2, 3 * length(a) // 3) AS matches,
         a = b OR (least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a))) OR (least(length(a), length(b)) >= 4 AND d <= greatest(1, 3 * greatest(length(a), length(b)) // 8)) AS similar FROM d""")
def strict_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", N.names_match(a, b).alias("matches"), N.similar(a, b).alias("similar"))


# -- the model's reading and evidence -------------------------------------------------------------------------------

from slipwright.operators import evidence as E  # noqa: E402
from slipwright.operators import items as I  # noqa: E402
from slipwright.operators import options as O  # noqa: E402
from slipwright.operators import solve as S  # noqa: E402
from slipwright.plans import jobs  # noqa: E402
from slipwright.streaming import joins  # noqa: E402

CLAIMED = """claimed AS (SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY item_no) AS INT) AS item_no, item_no AS src_no, name, quantity, CASE WHEN (rid + item_no) % 13 = 0 THEN CAST(floor(price / quantity) AS BIGINT) ELSE price END AS price, discount
  FROM items WHERE (rid + item_no) % 17 <> 0 AND rid % 23 <> 0)"""
COUNTS = """counts AS (SELECT rid, amount, count(*) AS n, count_if(row_no >= last) AS n_summary FROM (SELECT DISTINCT t.rid, t.row_no, abs(t.amount) AS amount, t.amount AS signed, g.last FROM tok t JOIN region g USING (rid) WHERE t.amount IS NOT NULL) GROUP BY rid, amount)"""


@query(f"""WITH {ITEMS}, {CLAIMED} SELECT t.rid, t.rid % 23 <> 0 AS ok, CASE WHEN t.rid % 23 <> 0 AND t.rid % 4 <> 0 THEN 'store ' || t.rid END AS store_name, CASE WHEN t.rid % 23 <> 0 THEN printed_total ELSE 0 END AS total_amount, count(c.rid) AS n_items, CAST(coalesce(sum(c.price), 0) AS BIGINT) AS price
  FROM totals t LEFT JOIN claimed c USING (rid) GROUP BY t.rid, printed_total""")
def vlm_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output parsed, placeholders scrubbed, leaves coerced."""
    receipts, items = jobs.read_responses(A.vlm_responses(spark, sf_dir))
    sums = items.groupBy("rid").agg(F.count("*").alias("n_items"), F.sum("price").alias("price"))
    out = receipts.join(sums, "rid", "left")
    return out.select("rid", "ok", "store_name", F.coalesce("total_amount", F.lit(0)).alias("total_amount"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("price", F.lit(0)).alias("price"))


@query(f"WITH {ITEMS} SELECT rid, CAST(8 + 5 * n + 2 * (SELECT count(*) FROM items i WHERE i.rid = t.rid AND i.discount > 0) - 2 * n - 1 + CASE WHEN fee > 0 THEN 2 ELSE 0 END AS BIGINT) AS n_lines, rid % 23 <> 0 AS ok FROM totals t")
def readings_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of a receipt; the model's may be unreadable."""
    lines = A.ocr_lines(spark, sf_dir).groupBy("rid").agg(F.count("*").alias("n_lines"))
    receipts, _ = jobs.read_responses(A.vlm_responses(spark, sf_dir))
    return lines.join(receipts.select("rid", "ok"), "rid", "left").select("rid", "n_lines", F.coalesce("ok", F.lit(False)).alias("ok"))


@query(f"WITH {PARSED}, {COUNTS} SELECT * FROM counts")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.amount_counts(_parsed(spark, sf_dir))


@query(f"WITH {PARSED}, {COUNTS} SELECT rid, amount FROM counts WHERE n_summary >= 2 AND amount >= 1000")
def repeated_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.repeated(E.amount_counts(_parsed(spark, sf_dir)))


#: Every third receipt is headed by a unit price, every tenth has a smudged fee row behind its total.
@query(f"WITH {OCR} SELECT rid, bool_or(regexp_matches(text, '배달|배민|쿠팡이츠|요기요|땡겨요')) OR rid % 10 = 0 AS delivery, rid % 10 = 0 AS fee_unread, rid % 3 = 0 AS unit_price_header FROM ocr GROUP BY rid")
def receipt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a receipt's print says about its kind."""
    lines = A.ocr_lines(spark, sf_dir)
    lines = lines.withColumn("text", F.when((F.col("rid") % 3 == 0) & (F.col("line_no") == 3), "단가").otherwise(F.col("text")))
    foot = A.totals(spark, sf_dir).filter("rid % 10 = 0").withColumn("y", 300 + 50 * F.col("n"))
    extra = [F.struct(F.lit(100_000 + k).alias("line_no"), F.lit(t).alias("text"), F.lit(0.95).alias("confidence"), F.lit(x).alias("x1"), F.col("y").cast("int").alias("y1"), F.lit(x + 60).alias("x2"), (F.col("y") + 30).cast("int").alias("y2")) for k, (t, x) in enumerate((("배달팁", 100), ("--", 600)))]
    lines = stored(lines.unionByName(foot.select("rid", F.explode(F.array(*extra)).alias("t")).select("rid", "t.*")), "lines")
    return E.flags(layout.parse_rows(layout.group_rows(layout.tokens(lines))), lines)


_CUTS = "cuts AS (SELECT rid, discount AS amount, count(*) AS n FROM items WHERE discount >= 100 GROUP BY rid, discount)"


@query(f"""WITH {ITEMS}, {_CUTS} SELECT rid, 'discount' AS kind, amount, n FROM cuts UNION ALL SELECT rid, 'paid', printed_total, 1 FROM totals WHERE printed_total >= 1000""")
def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid amounts and the multiset of discounts."""
    return E.evidence(_parsed(spark, sf_dir)).filter("kind <> 'unlabelled'")


@query(f"""WITH {ITEMS}, {CLAIMED}, {_CUTS} SELECT rid, amount, n - m AS n FROM (SELECT c.rid, c.amount, c.n, (SELECT count(*) FROM claimed x WHERE x.rid = c.rid AND x.discount = c.amount) AS m FROM cuts c) WHERE n > m""")
def discounts_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = A.claimed(spark, sf_dir).filter("discount > 0").select("rid", F.col("discount").alias("amount"))
    return E.unused_discounts(E.evidence(_parsed(spark, sf_dir)), used)


@query(f"""WITH {ITEMS}, p AS (SELECT DISTINCT rid, price FROM items), g AS (SELECT rid, sum(price) AS target FROM items GROUP BY rid UNION SELECT rid, sum(price) FROM items WHERE item_no <= 3 GROUP BY rid),
  h AS (SELECT a.rid, target FROM p a JOIN p b ON a.rid = b.rid AND a.price < b.price JOIN g ON g.rid = a.rid AND a.price + b.price = target AND b.price < target
    UNION SELECT a.rid, target FROM p a JOIN p b ON a.rid = b.rid AND a.price < b.price JOIN p c ON c.rid = a.rid AND b.price < c.price JOIN g ON g.rid = a.rid AND a.price + b.price + c.price = target
    UNION SELECT a.rid, target FROM p a JOIN p b ON a.rid = b.rid AND a.price < b.price JOIN p c ON c.rid = a.rid AND b.price < c.price JOIN p d ON d.rid = a.rid AND c.price < d.price JOIN g ON g.rid = a.rid AND a.price + b.price + c.price + d.price = target)
  SELECT rid, CAST(max(target) AS BIGINT) AS target FROM h GROUP BY rid""")
def split_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that two to four parts add up to (E7): item prices as parts, sums of items as targets."""
    items = A.items(spark, sf_dir)
    goals = items.groupBy("rid").agg(F.sum("price").alias("amount")).union(items.filter("item_no <= 3").groupBy("rid").agg(F.sum("price").alias("amount")))
    return E.split_payments(items.select("rid", F.col("price").alias("amount")), goals)


@query(f"""WITH {ITEMS} SELECT rid, printed_total AS value, tier FROM totals, (SELECT unnest([0, 1, 2]) AS tier) WHERE (tier = 1 OR (tier = 0 AND printed_total >= 1000) OR (tier = 2 AND rid % 23 <> 0))""")
def paid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)[2]


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, amount counts, paid candidates), each from stored tables."""
    receipts, _ = jobs.read_responses(A.vlm_responses(spark, sf_dir))
    # what all of these read of a row is written once, in the stage that lays the receipt out
    rows, claims = stored_together((E.money_rows(_parsed(spark, sf_dir)), "rows"), (receipts.filter("ok").select("rid", "total_amount"), "claims"))
    found, counts, totals = at_once(spark, lambda: stored(E.evidence(rows), "evidence"), lambda: stored(E.amount_counts(rows), "counts"), lambda: stored(layout.total_label(rows), "totals"))
    return found, counts, E.paid_candidates(found, counts, totals, claims)


# -- repairs of the item list ---------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT rid, item_no, label AS name, price FROM labelled WHERE ({_LEVEL}) < 2")
def label_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drop_label_rows(A.labelled(spark, sf_dir).withColumnRenamed("label", "name"))[0]


@query(f"""WITH {ITEMS}, g AS (SELECT rid, item_no, price % 5 * 100 + 100 AS amount, regexp_matches({_HANGUL}, '포인트|상품권|캐시|기프트|마일리지|예치금|선불|현금|머니') AS tender FROM labelled WHERE item_no % 2 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY rid, amount, tender ORDER BY item_no) AS k FROM g)
  SELECT rid, item_no, amount, CASE WHEN tender THEN 'tender' WHEN amount = 200 AND k <= 1 THEN 'counted' ELSE 'discount' END AS action FROM k""")
def negative_items_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.labelled(spark, sf_dir).select("rid", "item_no", F.col("label").alias("name"), F.when(F.col("item_no") % 2 == 0, -(F.col("price") % 5 * 100 + 100)).otherwise(F.col("price")).alias("price"))
    counted = rows.select("rid").distinct().select("rid", F.lit(200).cast("bigint").alias("amount"), F.lit(1).alias("n"))
    return I.fold_negatives(rows, counted)


@query(f"""WITH {ITEMS}, m AS (SELECT rid, max(price) AS amount FROM items WHERE item_no <= 3 GROUP BY rid), s AS (SELECT i.*, sum(price - discount) OVER (PARTITION BY rid) - (price - discount) AS others, count(*) OVER (PARTITION BY rid) AS c FROM items i)
  SELECT rid, item_no, price FROM s JOIN m USING (rid) WHERE NOT (item_no % 2 = 0 AND price >= amount AND others > 0 AND c >= 2)""")
def total_echoes_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = A.items(spark, sf_dir)
    totals = items.filter("item_no <= 3").groupBy("rid").agg(F.max("price").alias("amount"))
    rows = items.withColumns({"options": F.lit(0).cast("bigint"), "from_ocr": F.col("item_no") % 2 == 0})
    return I.drop_total_echoes(rows, totals).select("rid", "item_no", "price")


@query(f"WITH {ITEMS} SELECT rid, CASE WHEN printed_total % 20000 > 15000 THEN 0 ELSE printed_total % 20000 END AS fee FROM totals")
def fees_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(spark, sf_dir).select("rid", I.cap_fee(F.col("printed_total") % 20000).alias("fee"))


@query(f"""WITH {ITEMS}, k AS (SELECT rid, item_no, CASE WHEN rid % 2 = 0 THEN item_no WHEN rid % 3 = 0 THEN 10 - item_no % 3 END AS no FROM items),
  r AS (SELECT *, lag(no) OVER (PARTITION BY rid ORDER BY item_no) AS before FROM k) SELECT rid, count(no) >= 3 AND bool_and(no IS NULL OR before IS NULL OR no > before) AND count(no) >= 0.6 * count(*) AS numbered FROM r GROUP BY rid""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rid = F.col("item_no"), F.col("rid")
    no = F.when(rid % 2 == 0, k).when(rid % 3 == 0, 10 - k % 3)
    return I.has_line_numbers(A.items(spark, sf_dir).select("rid", "item_no", F.concat_ws(" ", F.lpad(no.cast("string"), 3, "0"), "name").alias("name")))


@query(f"""WITH {ITEMS} SELECT rid, item_no * 2 AS item_no, name, price, quantity FROM items""")
def barcode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and barcode lines apart on every third line put together again."""
    cut = (F.col("rid") + F.col("item_no")) % 3 == 0
    none = F.lit(None)
    head = F.struct((F.col("item_no") * 2).alias("item_no"), F.col("name").alias("name"), F.when(cut, none).otherwise(F.col("price")).cast("bigint").alias("price"), F.when(cut, none).otherwise(F.col("quantity")).cast("int").alias("quantity"))
    tail = F.struct((F.col("item_no") * 2 + 1).alias("item_no"), F.lit("8801234567890").alias("name"), F.col("price").alias("price"), F.col("quantity").alias("quantity"))
    rows = A.items(spark, sf_dir).select("rid", F.explode(F.when(cut, F.array(head, tail)).otherwise(F.array(head))).alias("x")).select("rid", "x.*")
    return I.pair_barcode_prices(rows).select("rid", "item_no", "name", "price", "quantity")


@query(f"WITH {ITEMS} SELECT rid, item_no, CASE WHEN quantity BETWEEN 2 AND 50 AND (rid + item_no) % 3 = 0 THEN price * quantity ELSE price END AS price FROM items")
def unit_price_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.items(spark, sf_dir).withColumn("layout_price", F.when((F.col("rid") + F.col("item_no")) % 3 == 0, F.col("price") * F.col("quantity")))
    return I.scale_unit_prices(rows)[0].select("rid", "item_no", "price")


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed items claimed by items of the model."""
    return I.match_items(A.claimed(spark, sf_dir), A.items(spark, sf_dir))


@query(f"WITH {ITEMS}, {CLAIMED} SELECT rid, count(*) AS n FROM items WHERE rid % 23 <> 0 AND (rid + item_no) % 17 = 0 AND (SELECT count(*) FROM claimed c WHERE c.rid = items.rid) > 0 GROUP BY rid")
def recovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many printed items are without a partner of their own as the model missed lines (J7). The merge recovers those
    of them that are no other line of a taken item either (J2's second tries); few here, as names are much alike."""
    items = A.items(spark, sf_dir)
    seen = A.claimed(spark, sf_dir)
    shown = items.join(seen.select("rid").distinct(), "rid").withColumn("name_conf", F.lit(0.9))
    every = I.match_items(seen.drop("name").join(items.select("rid", F.col("item_no").alias("src_no"), "name"), ["rid", "src_no"]), shown)
    return I.unmatched(shown, I.own_lines(every)).groupBy("rid").agg(F.count("*").alias("n"))


# -- reconciliation -------------------------------------------------------------------------------------------------

_EDITS = f"""{CLAIMED}, {_CUTS}, {COUNTS},
cand AS (SELECT rid, printed_total AS value, tier FROM totals, (SELECT unnest([0, 1, 2]) AS tier) WHERE tier = 1 OR (tier = 0 AND printed_total >= 1000) OR (tier = 2 AND rid % 23 <> 0)),
tax AS (SELECT DISTINCT value, unnest([CAST(floor(value / 11) AS BIGINT), CAST(ceil(value / 11) AS BIGINT), CAST(round_even(value / 11, 0) AS BIGINT)]) AS v FROM cand),
odd AS (SELECT rid, value AS amount FROM cand UNION SELECT rid, v FROM cand JOIN tax USING (value) UNION SELECT rid, value - v FROM cand JOIN tax USING (value) UNION SELECT rid, amount FROM counts WHERE n_summary > 0),
unused AS (SELECT c.rid, c.amount FROM cuts c LEFT JOIN (SELECT rid, discount, count(*) AS m FROM claimed GROUP BY ALL) u ON u.rid = c.rid AND u.discount = c.amount WHERE c.n > coalesce(m, 0)),
cl AS (SELECT *, count(*) OVER (PARTITION BY rid) AS c FROM claimed),
found AS (SELECT rid, 'drop_item' AS kind, 1.5 AS cost, item_no, 0 AS amount, -(price - discount) AS delta, 3 AS pref FROM cl WHERE c > 1 AND (price BETWEEN 1 AND 99 OR EXISTS (SELECT 1 FROM odd o WHERE o.rid = cl.rid AND o.amount = cl.price AND o.amount <> 0))
  UNION ALL SELECT rid, 'unit_price', 1.2, item_no, price * (quantity - 1), price * (quantity - 1), 5 FROM cl WHERE quantity BETWEEN 2 AND 50 AND price > 0 AND EXISTS (SELECT 1 FROM counts o WHERE o.rid = cl.rid AND o.amount = cl.price * cl.quantity)
  UNION ALL SELECT rid, 'drop_item_discount', 1.2 - 0.001 * (item_no - 1), item_no, 0, discount, 7 FROM cl WHERE discount > 0
  UNION ALL SELECT rid, 'add_discount', 1.0, -1, amount, -amount, 1 FROM unused),
edits AS (SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY cost, pref, item_no, amount) AS INT) AS edit_id, kind, CAST(cost AS DOUBLE) AS cost, CAST(item_no AS INT) AS item_no, CAST(amount AS BIGINT) AS amount, CAST(delta AS BIGINT) AS delta, pref FROM found),
base AS (SELECT c.rid, CAST(sum(c.price - c.discount) + max(t.fee) AS BIGINT) AS computed FROM claimed c JOIN totals t USING (rid) GROUP BY c.rid),
needs AS (SELECT rid, value, tier, value - computed AS needed FROM cand JOIN base USING (rid) WHERE tier < 2),
combos AS (SELECT rid, value, tier, 0.0 AS cost, '' AS kinds, '' AS ids, '' AS pref FROM needs WHERE needed = 0
  UNION ALL SELECT n.rid, value, tier, cost, kind, CAST(edit_id AS VARCHAR), lpad(CAST(pref AS VARCHAR), 2, '0') FROM needs n JOIN edits e ON e.rid = n.rid AND e.delta = n.needed WHERE needed <> 0
  UNION ALL SELECT n.rid, value, tier, a.cost + b.cost, a.kind || ',' || b.kind, a.edit_id || ',' || b.edit_id, lpad(CAST(least(a.pref, b.pref) AS VARCHAR), 2, '0') || ',' || lpad(CAST(greatest(a.pref, b.pref) AS VARCHAR), 2, '0')
    FROM needs n JOIN edits a ON a.rid = n.rid JOIN edits b ON b.rid = n.rid AND a.edit_id < b.edit_id AND a.delta + b.delta = n.needed WHERE needed <> 0 AND (a.kind = 'add_discount' OR b.kind = 'add_discount' OR a.item_no <> b.item_no))"""


def _solver(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, candidates, edits) of the derived receipts."""
    found, counts, candidates = _evidence(spark, sf_dir)
    candidates = stored(candidates, "candidates")
    seen = A.claimed(spark, sf_dir)
    used = seen.filter("discount > 0").select("rid", F.col("discount").alias("amount"))
    items = seen.withColumns({"options": F.lit(0).cast("bigint"), "layout_price": F.lit(0).cast("bigint"), "from_ocr": F.lit(False)})
    base = seen.groupBy("rid").agg(F.sum(F.col("price") - F.col("discount")).alias("_s")).join(A.totals(spark, sf_dir), "rid").select("rid", (F.col("_s") + F.col("fee")).alias("computed"))
    return stored(base, "base"), candidates, stored(S.edits(items, candidates, counts, E.unused_discounts(found, used)), "edits")


@query(f"WITH {PARSED}, {_EDITS} SELECT rid, edit_id, kind, cost, item_no, amount, delta FROM edits")
def edit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solver(spark, sf_dir)[2].select("rid", "edit_id", "kind", "cost", "item_no", "amount", "delta")


@query(f"WITH {PARSED}, {_EDITS} SELECT rid, value, tier, CAST(cost AS DOUBLE) AS cost, kinds, ids AS edit_ids FROM combos")
def edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations that balance."""
    base, candidates, found = _solver(spark, sf_dir)
    needs = candidates.filter("tier < 2").join(base, "rid").withColumn("needed", F.col("value") - F.col("computed"))
    return S.balancing(found, needs).select("rid", "value", "tier", "cost", F.array_join("kinds", ",").alias("kinds"), F.array_join(F.col("edit_ids").cast("array<string>"), ",").alias("edit_ids"))


@query(f"""WITH {PARSED}, {_EDITS}, bal AS (SELECT DISTINCT rid FROM needs WHERE tier = 1 AND needed = 0),
  low AS (SELECT *, min(tier) OVER (PARTITION BY rid) AS lt FROM combos), least AS (SELECT *, min(round(cost * 1000000)) OVER (PARTITION BY rid) AS lc FROM low WHERE tier = lt),
  top AS (SELECT *, count(DISTINCT value) OVER (PARTITION BY rid) AS nv, row_number() OVER (PARTITION BY rid ORDER BY pref, string_split(ids, ',')::INT[]) AS k FROM (SELECT *, nullif(ids, '') AS i2 FROM least WHERE round(cost * 1000000) = lc) WHERE i2 IS NOT NULL
    UNION ALL SELECT *, 1, 1 FROM (SELECT *, nullif(ids, '') AS i2 FROM least WHERE round(cost * 1000000) = lc) WHERE i2 IS NULL)
  SELECT rid, value AS paid, tier, CAST(cost AS DOUBLE) AS cost, kinds FROM top WHERE nv = 1 AND k = 1""")
def solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one solution a receipt."""
    return S.solve(*_solver(spark, sf_dir)).select("rid", "paid", "tier", "cost", F.array_join("kinds", ",").alias("kinds"))


_CHOSEN = f"""{_EDITS},
  low AS (SELECT *, min(tier) OVER (PARTITION BY rid) AS lt FROM combos), least AS (SELECT *, min(round(cost * 1000000)) OVER (PARTITION BY rid) AS lc FROM low WHERE tier = lt),
  cheapest AS (SELECT * FROM least WHERE round(cost * 1000000) = lc), ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pref, CASE WHEN ids = '' THEN NULL ELSE string_split(ids, ',')::INT[] END) AS k FROM cheapest),
  sol AS (SELECT rid, value AS paid, ids FROM ranked WHERE k = 1 AND rid NOT IN (SELECT rid FROM cheapest GROUP BY rid HAVING count(DISTINCT value) > 1)),
  used AS (SELECT rid, edit_id, e.kind, e.item_no, e.amount FROM (SELECT rid, unnest(string_split(ids, ','))::INT AS edit_id FROM sol WHERE ids <> '') JOIN edits e USING (rid, edit_id)),
  changed AS (SELECT rid, item_no, list(kind) AS kinds, max(CASE WHEN kind = 'unit_price' THEN amount END) AS more FROM used WHERE item_no >= 0 GROUP BY rid, item_no),
  after AS (SELECT c.rid, c.item_no, CAST(c.price + coalesce(more, 0) AS BIGINT) AS price, CAST(CASE WHEN list_contains(kinds, 'drop_item_discount') THEN 0 ELSE discount END AS BIGINT) AS discount FROM claimed c LEFT JOIN changed USING (rid, item_no) WHERE NOT coalesce(list_contains(kinds, 'drop_item'), false))"""


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items after the chosen edits, what changes for the receipts, solutions)."""
    base, candidates, found = _solver(spark, sf_dir)
    solutions = stored(S.solve(base, candidates, found), "solutions")
    items = A.claimed(spark, sf_dir).withColumns({"options": F.lit(0).cast("bigint"), "layout_price": F.lit(0).cast("bigint"), "from_ocr": F.lit(False)})
    return S.apply_edits(items, found, solutions), S.receipt_changes(found, solutions), solutions


@query(f"WITH {PARSED}, {_CHOSEN} SELECT rid, item_no, price, discount FROM after")
def applied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items after the chosen edits."""
    return _applied(spark, sf_dir)[0].select("rid", "item_no", "price", "discount")


@query(f"""WITH {PARSED}, {_CHOSEN}, off AS (SELECT rid, sum(amount) AS added FROM used WHERE kind = 'add_discount' GROUP BY rid), sums AS (SELECT rid, sum(price - discount) AS s FROM after GROUP BY rid)
  SELECT rid, paid AS total_amount, CAST(coalesce(added, 0) AS BIGINT) AS discount, coalesce(CAST(s - coalesce(added, 0) + fee AS BIGINT) = paid, false) AS balanced FROM sol LEFT JOIN off USING (rid) LEFT JOIN sums USING (rid) JOIN totals USING (rid)""")
def verified_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equation of each solved receipt after its edits (E15, P9): items less discounts and with the fee are what was paid."""
    items, changes, solutions = _applied(spark, sf_dir)
    sums = items.groupBy("rid").agg(F.sum(M.line_total(F.col("price"), F.col("options"), F.col("discount"))).alias("_s"))
    out = solutions.join(changes, "rid").join(sums, "rid", "left").join(A.totals(spark, sf_dir).select("rid", F.col("fee").alias("_fee")), "rid")
    balanced = F.coalesce(F.col("_s") - F.col("added_discount") + F.col("added_fee") + F.col("_fee") == F.col("paid"), F.lit(False))
    return out.select("rid", F.col("paid").alias("total_amount"), F.col("added_discount").alias("discount"), balanced.alias("balanced"))


_LIKE = """like_ AS (SELECT rid, total AS amount FROM goal UNION SELECT rid, v FROM goal, unnest([CAST(floor(total / 11) AS BIGINT), CAST(ceil(total / 11) AS BIGINT), CAST(round_even(total / 11, 0) AS BIGINT)]) AS t(v)
  UNION SELECT rid, total - v FROM goal, unnest([CAST(floor(total / 11) AS BIGINT), CAST(ceil(total / 11) AS BIGINT), CAST(round_even(total / 11, 0) AS BIGINT)]) AS t(v))"""


def _plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.items(spark, sf_dir).withColumns({"options": F.lit(0).cast("bigint"), "layout_price": F.lit(0).cast("bigint"), "from_ocr": F.lit(False)})


def _no_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rid bigint, amount bigint, n bigint, n_summary bigint")


#: Every item has an option: the price of the next item, the total below the last one of even receipts, else 77.
@query(f"""WITH {ITEMS}, goal AS (SELECT rid, printed_total AS total FROM totals), {_LIKE},
  subs AS (SELECT rid, item_no, coalesce(lead(price) OVER (PARTITION BY rid ORDER BY item_no), CASE WHEN rid % 2 = 0 THEN printed_total ELSE 77 END) AS price FROM items JOIN totals USING (rid))
  SELECT rid, item_no, 1 AS sub_no, CAST(cost AS DOUBLE) AS cost, CAST(-price AS BIGINT) AS delta FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM like_ l WHERE l.rid = s.rid AND l.amount = s.price) THEN 1.0
    WHEN EXISTS (SELECT 1 FROM items i WHERE i.rid = s.rid AND i.price = s.price AND i.item_no <> s.item_no) THEN 1.3 END AS cost FROM subs s WHERE price > 0) WHERE cost IS NOT NULL""")
def option_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that may go, as they repeat a total or another item's price."""
    items, totals = stored(_plain_items(spark, sf_dir), "items"), A.totals(spark, sf_dir)
    following = F.lead("price").over(Window.partitionBy("rid").orderBy("item_no"))
    subs = items.join(totals.select("rid", "printed_total"), "rid").select("rid", "item_no", F.lit(1).alias("sub_no"), F.lit("치즈추가").alias("name"), F.coalesce(following, F.when(F.col("rid") % 2 == 0, F.col("printed_total")).otherwise(77)).cast("bigint").alias("price"))
    goal = totals.select("rid", F.col("printed_total").alias("value"), F.lit(1).alias("tier"))
    none = spark.createDataFrame([], "rid bigint, amount bigint")
    return S.edits(items, goal, _no_counts(spark), none, subs=subs).filter("kind = 'drop_sub'").select("rid", "item_no", F.col("ref").alias("sub_no"), "cost", "delta")


def _no_edits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rid bigint, edit_id int, kind string, cost double, item_no int, amount bigint, delta bigint, ref int, off bigint, scaled boolean")


@query(f"""WITH {ITEMS}, g AS (SELECT t.rid, printed_total, printed_total - s AS gap FROM totals t JOIN (SELECT rid, CAST(sum(price - discount) AS BIGINT) AS s FROM items GROUP BY rid) USING (rid))
  SELECT rid, printed_total AS paid, CASE WHEN gap = 0 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS cost, gap AS fee FROM g WHERE gap = 0 OR (rid % 2 = 0 AND gap BETWEEN 100 AND 10000 AND gap % 100 = 0) OR (rid % 2 = 1 AND gap = 3000)""")
def fee_gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees filled in from the gap (E13): even receipts have a smudged fee row, odd ones a stray 3,000."""
    base = A.items(spark, sf_dir).groupBy("rid").agg(F.sum(F.col("price") - F.col("discount")).alias("computed"))
    goal = A.totals(spark, sf_dir).select("rid", F.col("printed_total").alias("value"), F.lit(0).alias("tier"))
    odd = F.col("rid") % 2 == 1
    fees = base.select("rid", (~odd).alias("unread"), F.when(odd, F.array(F.lit(3000).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("stray"))
    return S.solve(base, goal, _no_edits(spark), fees).select("rid", "paid", "cost", "fee")


#: The first two items of each receipt are missed; the receipt's discount is that of both (odd receipts), or the larger.
_MISSED = f"""{ITEMS}, lost AS (SELECT rid, max(CASE WHEN item_no = 1 THEN price END) AS p1, max(CASE WHEN item_no = 2 THEN price END) AS p2, max(CASE WHEN item_no = 1 THEN discount END) AS d1, max(CASE WHEN item_no = 2 THEN discount END) AS d2,
    CAST(coalesce(sum(CASE WHEN item_no > 2 THEN price - discount END), 0) AS BIGINT) AS rest, count(*) AS n FROM items GROUP BY rid HAVING count(*) > 2),
  goal AS (SELECT rid, rest - top + p1 + p2 AS total FROM (SELECT *, CASE WHEN rid % 2 = 1 THEN d1 + d2 ELSE greatest(d1, d2) END AS top FROM lost))"""


@query(f"""WITH {_MISSED}, {_LIKE} SELECT rid, total AS paid, 'add_item,add_item' AS kinds FROM lost JOIN goal USING (rid) WHERE (rid % 2 = 1 OR least(d1, d2) = 0)
  AND NOT EXISTS (SELECT 1 FROM like_ l WHERE l.rid = lost.rid AND l.amount IN (p1, p2))""")
def restores_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines restored together, if their discounts are in the receipt's."""
    items = stored(_plain_items(spark, sf_dir), "items")
    first, second = (F.max(F.when(F.col("item_no") == k, F.col("discount"))) for k in (1, 2))
    price = F.sum(F.when(F.col("item_no") <= 2, F.col("price")))
    sums = items.groupBy("rid").agg(F.sum(F.when(F.col("item_no") > 2, F.col("price") - F.col("discount"))).alias("_rest"), price.alias("_p"), F.when(F.col("rid") % 2 == 1, first + second).otherwise(F.greatest(first, second)).alias("top"), F.count("*").alias("_n")).filter("_n > 2")
    base = stored(sums.select("rid", (F.col("_rest") - F.col("top")).alias("computed"), "top", (F.col("_rest") - F.col("top") + F.col("_p")).alias("value")), "base")
    goal = base.select("rid", "value", F.lit(1).alias("tier"))
    lost = items.filter("item_no <= 2").join(base.select("rid"), "rid", "left_semi").select("rid", F.col("item_no").alias("ref"), "name", "quantity", "price", "discount")
    none = spark.createDataFrame([], "rid bigint, amount bigint")
    found = S.edits(items.filter("item_no > 2"), goal, _no_counts(spark), none, lost, current=base.select("rid", F.col("top").alias("amount")))
    found = found.filter("kind = 'add_item'")
    return S.solve(base.select("rid", "computed", "top"), goal, found).select("rid", "paid", F.array_join("kinds", ",").alias("kinds"))


@query(f"WITH {ITEMS} SELECT rid, printed_total AS paid FROM totals WHERE rid % 3 <> 0")
def larger_labels_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced total is none where a larger amount is labelled as paid (E12): on every third receipt."""
    totals = A.totals(spark, sf_dir)
    more = F.when(F.col("rid") % 3 == 0, 5000).otherwise(-5000)
    goal = totals.select("rid", F.col("printed_total").alias("value"), F.lit(1).alias("tier")).union(totals.select("rid", F.col("printed_total") + more, F.lit(0)))
    return S.solve(totals.select("rid", F.col("printed_total").alias("computed")), goal, _no_edits(spark)).select("rid", "paid")


@query(f"""WITH {ITEMS}, m AS (SELECT *, (rid * 3 + item_no) % 7 = 0 AND item_no > 1 AS mark, lag(name) OVER w AS up, lag(discount) OVER w AS up_off FROM items WINDOW w AS (PARTITION BY rid ORDER BY item_no)),
  o AS (SELECT rid, name AS opt, CASE WHEN up_off > 0 THEN '행사할인' ELSE up END AS above FROM m WHERE mark)
  SELECT rid, item_no - 1 AS item_no, name, price FROM m WHERE discount = 0 AND item_no > 1 AND EXISTS (SELECT 1 FROM o WHERE o.rid = m.rid AND opt = name
      AND (above = up OR contains(above, substr(up, 1, 3)) OR contains(up, substr(above, 1, 3)) OR contains(above, right(up, 3))))
    AND NOT EXISTS (SELECT 1 FROM m x WHERE x.rid = m.rid AND x.name = m.name AND NOT x.mark)""")
def printed_options_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are printed with an option mark below the item before them."""
    items = A.items(spark, sf_dir)
    none = items.limit(0).select("rid", "item_no", F.lit(1).alias("sub_no"), "name", "price")
    return O.demote_printed(stored(items, "items"), none, stored(_rows(spark, sf_dir), "rows"), none.select("rid"))[1].select("rid", "item_no", "name", "price")


_merges: dict = {}


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The merge of a folder, run once in a session and written to the shared folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _merges:
        lines, responses = stored_together((A.ocr_lines(spark, sf_dir), "lines"), (A.answers(spark, sf_dir), "responses"))
        merged = jobs.merge(lines, responses, today="2024-06-01")
        wanted = ("receipts", "items", "options", "corrections")
        _merges[key] = dict(zip(wanted, stored_together(*[(merged[k], k) for k in wanted])))
    return _merges[key]


@query()
def merged_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole merge of both readings."""
    return _merged(spark, sf_dir)["receipts"]


@query()
def receipt_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON envelope for each receipt."""
    return jobs.envelopes(_merged(spark, sf_dir), {"prompt": "v1"})


@query()
def corrections_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(_merged(spark, sf_dir)["corrections"])


@query()
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the merge against the true receipts (E21). Lines printed with an option mark are options in truth;
    refunds are left out."""
    merged = _merged(spark, sf_dir)
    rid, k = F.col("rid"), F.col("item_no")
    items = A.items(spark, sf_dir).filter(rid % A.REFUND != 0)
    wanted = items.filter(((rid * 3 + k) % 7 == 0) & (k > 1)).select("rid", "name", "price")
    net = items.groupBy("rid").agg(F.sum(F.col("price") - F.col("discount")).alias("_net"))
    truth = A.totals(spark, sf_dir).join(net, "rid").select("rid", F.col("printed_total").alias("total_amount"), (F.col("_net") + F.col("fee")).alias("net"))
    sold = merged["receipts"].filter(rid % A.REFUND != 0)
    return C.measures(C.by_receipt(sold, merged["items"], merged["options"].join(sold.select("rid"), "rid", "left_semi"), truth, wanted))


@query(f"""WITH {ITEMS} SELECT rid, CAST(printed_total AS BIGINT) AS plain_total, CAST(printed_total - CASE WHEN rid % 7 = 0 THEN 500 ELSE 0 END AS BIGINT) AS tilted_total, rid % 2 = 0 AS plain_verified, rid % 3 = 0 AS tilted_verified, 0 AS plain_edits, 1 AS tilted_edits,
  rid % 7 <> 0 AS agree, rid % 19 <> 0 AS plain_right, rid % 7 <> 0 AND rid % 19 <> 0 OR (rid % 7 = 0 AND rid % 19 = 0 AND 1000 = 500) AS tilted_right FROM totals""")
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side, and against the true totals (E22): the second is 500 off on every seventh receipt."""
    totals = stored(A.totals(spark, sf_dir), "totals")
    rid = F.col("rid")
    plain = totals.select("rid", F.col("printed_total").alias("total_amount"), (rid % 2 == 0).alias("items_verified"), F.lit(0).alias("n_edits"))
    tilted = totals.select("rid", (F.col("printed_total") - F.when(rid % 7 == 0, 500).otherwise(0)).alias("total_amount"), (rid % 3 == 0).alias("items_verified"), F.lit(1).alias("n_edits"))
    truth = totals.select("rid", (F.col("printed_total") - F.when(rid % 19 == 0, 1000).otherwise(0)).alias("total_amount"))
    return jobs.compare_runs({"plain": plain, "tilted": tilted}, truth)
