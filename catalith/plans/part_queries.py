"""Queries of the text and measure functions over texts made of parts' names, sizes and brands; the SQL works each result out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions import identifiers as I
from catalith.functions import measure as M
from catalith.functions import text as X
from catalith.operators import resolve as J
from catalith.operators import style as Y
from catalith.plans.text_queries import _VALID, _codes
from catalith.session import prepare, table
from catalith.sources import tables as T


def _part(s, d):
    return table(prepare(s), d, "part").withColumns({"size": F.col("p_size").cast("string"), "next": (F.col("p_size") + 1).cast("string"), "noun": F.element_at(F.split("p_name", " "), -1)})


def _out(*texts: str, fn, show=lambda c: c):
    """fn of one of the texts, SQL expressions, by the part's key; the same expressions are read by both engines."""

    def run(s, d):
        text: Column = F.expr(texts[-1])
        for i, t in enumerate(texts[:-1]):
            text = F.when(F.col("p_partkey") % len(texts) == i, F.expr(t)).otherwise(text)
        # step by step, so that nothing is worked out twice
        return _part(s, d).select("p_partkey", text.alias("text")).select("p_partkey", fn(F.col("text")).alias("made")).select("p_partkey", show(F.col("made")).alias("out"))

    return run


def _sql(*outs: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(outs))
    return f"WITH p AS (SELECT *, p_size::VARCHAR AS size, (p_size + 1)::VARCHAR AS next, split_part(p_name, ' ', -1) AS noun FROM part) SELECT p_partkey, CASE p_partkey % {len(outs)} {cases} END AS out FROM p"


#: A text of 40 characters at most, cut between words.
_CUT = "CASE WHEN length({0}) <= 40 THEN {0} ELSE regexp_replace(regexp_replace(({0})[1:40], ' [^ ]*$', ''), '[ ,;:\\-|/]+$', '') END"
_SHORT = "length(regexp_replace(noun, '[aeiou]', '', 'g'))"
_PLAUSIBLE = f"length(noun) >= 5 AND {_SHORT} >= 3 AND {_SHORT} / length(noun) BETWEEN 0.3 AND 0.85"
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _heads(s, d):
    cases = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(" Corporation"))).when(F.col("p_partkey") % 3 == 1, F.lit("")).otherwise(F.col("p_type"))
    brand = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("®"))).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return _part(s, d).select("p_partkey", Y.mobile_head(cases, brand).alias("out"))


def _pairs(fn, turned: bool):
    def run(s, d):
        word = F.upper("noun")
        short = F.regexp_replace(word, "[AEIOU]", "")
        short = F.when(F.col("p_partkey") % 3 == 0, F.reverse(short)).when(F.col("p_partkey") % 3 == 1, word).otherwise(short)
        return _part(s, d).select("p_partkey", (fn(word, short) if turned else fn(short, word)).alias("out"))

    return run


def _barcodes(s, d):
    code = _codes(s, d).filter(F.length("code") == 12)
    found = I.labelled_barcodes(F.concat(F.lit("about UPC: "), "code", F.lit(", and GTIN 1234")))
    return code.select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["target"], x["code"])), ",").alias("out"))


def _wrapped(s, d):
    pages = table(prepare(s), d, "pages")
    whole = F.concat(F.lit("https://s.io/l/?uddg="), F.url_encode("url"), F.lit("&r=1"))
    return pages.select("page_id", I.unwrapped(F.when(F.col("page_id") % 2 == 0, whole).otherwise(F.col("url"))).alias("out"))


def _headers(s, d):
    have, want = (T.header(table(prepare(s), d, t)) for t in ("lineitem", "orders"))
    return J.header_difference([c.split("_")[-1] for c in have], [c.split("_")[-1] for c in want], prepare(s)).select("header", "problem")


def _delivered(s, d):
    names = T.delivery_columns(*[T.header(table(prepare(s), d, t)) for t in ("part", "supplier", "lineitem")])
    return prepare(s).createDataFrame(list(enumerate(names)), "place long, name string").filter("name like 'p\\_%' or name like 's\\_%' or name like 'l\\_%' or name like '% 50' or name like '%\\_20' or name like 'Ref%'")


_DELIVERED = """
    WITH d AS (SELECT 0 AS t, column_name AS name, row_number() OVER () AS place FROM (DESCRIBE part) UNION ALL SELECT 1, column_name, row_number() OVER () FROM (DESCRIBE supplier) UNION ALL SELECT 2, column_name, row_number() OVER () FROM (DESCRIBE lineitem)),
    n AS (SELECT count(*) FILTER (t = 0) AS p, count(*) FILTER (t = 1) AS s FROM d)
    SELECT 16 + d.place + CASE t WHEN 0 THEN 0 WHEN 1 THEN p + 20 ELSE p + s + 170 END AS place, name FROM d, n
    UNION ALL SELECT 17 + p + 19, 'ITEM_FEATURES_20' FROM n
    UNION ALL SELECT i, 'Ref URL ' || i FROM range(1, 6) AS r(i)
    UNION ALL SELECT 17 + p + s + 20 + 147 + i, ['ATTRIBUTE_LABEL 50', 'ATTRIBUTE_VALUE 50', 'ATTRIBUTE_UOM 50'][i + 1] FROM n, range(3) AS r(i)"""

QUERIES = {
    "o006_delivery_columns": (_delivered, _DELIVERED),
    "o022_is_placeholder": (_out("'-- No Brand --'", "' n/a '", "p_name", "cast(NULL as string)", "p_brand", fn=X.is_placeholder), _sql("true", "true", "false", "true", "false")),
    "o024_strip_condition": (_out("p_name || ' - Display Only'", "p_name || ' (Refurbished)'", "p_name || ' Display Panel'", "p_name || ' - Scratch & Dent'", "p_name", fn=X.strip_condition), _sql("p_name", "p_name", "p_name || ' Display Panel'", "p_name", "p_name")),
    "o027_country_name": (_out("'CN'", "'us.'", "p_type", "p_name", fn=X.country_name), _sql("'China'", "'United States'", "p_type", "p_name")),
    "o028_canonical_unit": (_out("'Inches'", "'LBS.'", "p_name", "'kwh'", "p_type", fn=X.canonical_unit), _sql("'in'", "'lb'", "p_name", "'kW-hr'", "p_type")),
    "o029_space_units": (_out("size || 'in x ' || next || 'FT ' || p_name", "p_name || ' ' || size || 'v ' || next || 'A 60hz'", "p_name || ' inch'", fn=X.space_units), _sql("size || ' in x ' || next || ' ft ' || p_name", "p_name || ' ' || size || ' V ' || next || ' A 60 Hz'", "p_name || ' inch'")),
    "o030_measure_text": (_out("size || '.25\" H ' || p_name", "size || ' 3/4 in'", "p_name || ' ' || size || 'IN'", "size || ''' cord'", "p_name || ' ' || size || '.68 gal'", fn=M.measure_text), _sql("size || '-1/4 in H ' || p_name", "size || '-3/4 in'", "p_name || ' ' || size || ' in'", "size || ' ft cord'", "p_name || ' ' || size || '.68 gal'")),
    "o031_title_case": (_out("p_name || ' with pir'", "'led ' || p_name || ' for the home'", "'of ' || p_name", "'(pvc) ' || p_name", fn=X.title_case), _sql(f"{_TITLE} || ' with Pir'", f"'LED ' || {_TITLE} || ' for the Home'", f"'Of ' || {_TITLE}", f"'(PVC) ' || {_TITLE}")),
    "o033_invoice_line": (_out("p_name", "p_name || ' ' || p_type", "'stainless steel duplex receptacle cover with mounting bracket'", "'industrial square toggle switch cover plate black'", "'incandescent refrigerator ' || noun || ' and galvanized aluminum'", "'fluorescent ' || noun || ' without charger, dishwasher dishwasher'", "p_name || '® '", fn=X.invoice_line_folded), _sql("upper(p_name)", "upper(p_name || ' ' || p_type)", "'SST DUPLEX RCPT COVER WITH MTG BRACKET'", "'INDL SQ TOGGLE SWITCH COVER PLATE BLACK'", "'INCAND REFRIG ' || upper(noun) || ' AND GALV ALUMINUM'", _CUT.format("'FLUOR ' || upper(noun) || ' W/O CHGR, DISHWASHER DISHWASHER'"), "upper(p_name)")),
    "o034_abbreviate": (_out("'Steel Cover, ' || p_name", "p_name || ' COVER'", "p_name", fn=lambda c: X.abbreviate(c, X.literal_map({"cover": "CVR", "steel": "STL"}))), _sql("'STL CVR ' || p_name", "p_name || ' CVR'", "p_name")),
    "o035_glue_units": (_out("size || ' V ' || p_name || ' ' || next || ' A'", "size || ' IN x ' || next || ' FT'", "size || ' in ' || p_name", fn=X.glue_units), _sql("size || 'V ' || p_name || ' ' || next || 'A'", "size || 'IN x ' || next || 'FT'", "size || ' in ' || p_name")),
    "o038_fractions_in_text": (_out("'0.5 in and ' || size || '.25 ' || p_name", "size || ' 3/4 ' || p_name", "'v' || size || '.5 ' || p_name", "size || '.0 ft'", fn=M.fractions_in_text), _sql("'1/2 in and ' || size || '-1/4 ' || p_name", "size || '-3/4 ' || p_name", "'v' || size || '.5 ' || p_name", "size || ' ft'")),
    "o039_snap_decimal_inches": (_out("size || '.6 in'", "size || '.5in'", "size || '.25\"'", "size || '.6 mm'", "size || '.99 in ' || p_name", fn=M.snap_decimal_inches), _sql("size || '-5/8 in'", "size || '-1/2 in'", "size || '-1/4 in'", "size || '.6 mm'", "next || ' in ' || p_name")),
    "o039_snap_inches": (_out("size || '.6'", "size || '.99'", "size || '.01'", "p_name", fn=M.snap_inches), _sql("size || '-5/8'", "next", "size", "p_name")),
    "o044_dimensions": (_out("size || '-7/16 in H x ' || next || ' in W'", "size || ' cm L'", "p_name", fn=M.dimensions, show=lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["axis"], x["value"], x["unit"])), ",")), _sql("'HEIGHT:' || size || '-7/16:in,WIDTH:' || next || ':in'", "'LENGTH:' || size || ':cm'", "''")),
    "o045_split_measure": (_out("size || ' inches'", "size || '.6 in'", "size || ' 3/4 in'", "p_name", fn=M.split_measure, show=lambda c: F.concat_ws("|", c["value"], c["unit"])), _sql("size || '|in'", "size || '-5/8|in'", "size || '-3/4|in'", "p_name || '|'")),
    "o046_singular": (_out("noun || 's'", "noun", fn=X.singular), _sql("CASE noun WHEN 'plate' THEN 'plat' ELSE noun END", "noun")),
    "o046_plural": (_out("noun", "noun || ' box'", "noun || ' battery'", "noun || ' key'", "noun || ' switch'", "noun || ' brush'", "noun || ' lens'", "noun || ' topaz'", "upper(noun) || ' CITY'", "'cycle'", fn=X.plural), _sql("noun || 's'", "noun || ' boxes'", "noun || ' batteries'", "noun || ' keys'", "noun || ' switches'", "noun || ' brushes'", "noun || ' lenses'", "noun || ' topazes'", "upper(noun) || ' CITies'", "'cycles'")),
    "o049_is_abbreviation": (_pairs(X.is_abbreviation, False), _sql("false", "false", "upper(noun) <> 'ANVIL'")),
    "o050_plausible_abbreviation": (_pairs(X.plausible_abbreviation, True), _sql(_PLAUSIBLE, "false", _PLAUSIBLE)),
    "o056_head": (_heads, _sql("p_type", "p_brand", "p_type || ' ' || p_name")),
    "o060_labelled_barcodes": (_barcodes, f"WITH c AS (SELECT p_partkey, right(lpad(CAST(p_partkey * 7919 AS VARCHAR), 13, '0') || CAST(p_partkey % 10 AS VARCHAR), 12) AS code FROM part) SELECT p_partkey, CASE WHEN {_VALID} THEN 'UPC=' || code ELSE '' END AS out FROM c"),
    "o102_header_difference": (_headers, "WITH a AS (SELECT string_split(column_name, '_')[-1] AS header, row_number() OVER () AS place FROM (DESCRIBE lineitem)), b AS (SELECT string_split(column_name, '_')[-1] AS header, row_number() OVER () AS place FROM (DESCRIBE orders)) SELECT header, CASE WHEN a.place IS NULL THEN 'missing' WHEN b.place IS NULL THEN 'added' ELSE 'misordered' END AS problem FROM a FULL JOIN b USING (header) WHERE a.place IS DISTINCT FROM b.place"),
    "o183_unwrapped": (_wrapped, "SELECT page_id, url AS out FROM pages"),
}
