"""Queries of names, texts and archives over derived files and the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import naming
from tessera.plans.registry import Inputs, query

_ORDERED = """f as (select archive, name, regexp_extract(name, '(?i)^.+(\\.omap|\\.xmap|\\.png)$', 1) as suffix from {map_names}),
s as (select archive, name, suffix, left(name, length(name) - length(suffix)) as stem from f),
d as (select *, regexp_extract(stem, '^([0-9]*)', 1) as digits, regexp_extract(stem, '^[0-9]*([_ -]*)', 1) as separator, regexp_extract(stem, '^[0-9]*[_ -]*(.*)$', 1) as rest from s),
o as (select *, case when digits <> '' then cast(digits as bigint) end as ordinal from d),
n as (select *, row_number() over (partition by archive order by ordinal asc nulls last, name) - 1 as place, greatest(3, length(cast(count(*) over (partition by archive) - 1 as varchar))) as width from o),
c as (select *, lpad(cast(place as varchar), greatest(width, length(cast(place as varchar)))::int, '0') || '__' || case when rest = '' then 'map' else replace(rest, ' ', '_') end as new_stem from n),
m as (select c.*, new_stem || suffix as corrected, e.name is not null as has_image from c left join {image_names} e on e.archive = c.archive and e.name = c.stem || '.png')"""

_KINDS = """r as (select archive, name, unnest(list_filter([case when ordinal is null then 'no leading number' end, case when ordinal is not null and length(digits) <> width then 'leading number of the wrong width' end,
 case when ordinal is not null and ordinal <> place then 'leading number out of sequence' end, case when ordinal is not null and separator <> '__' then 'wrong separator after the leading number' end,
 case when contains(rest, ' ') then 'spaces in the name' end], lambda x: x is not null)) as kind from m),
z as (select archive, kind from r union all select archive, 'renamed with the map it belongs to' from m where has_image and new_stem <> stem
 union all select m.archive, 'does not match the naming rules' from m where corrected <> name and not exists (select 1 from r where r.archive = m.archive and r.name = m.name)
 union all select archive, 'a map with no reference image' from m where not has_image
 union all select e.archive, 'a reference image belonging to no map' from {image_names} e where not exists (select 1 from m where m.archive = e.archive and m.stem || '.png' = e.name))"""


@query("with " + _ORDERED + " select archive, name, place, cast(width as integer) as width, stem, suffix, digits, separator, rest from m")
def naming_order(t: Inputs) -> DataFrame:
    return naming.ordered(t.map_names).select("archive", "name", F.col("place").cast("long").alias("place"), "width", "stem", "suffix", "digits", "separator", "rest")


@query("with " + _ORDERED + """ select archive, 'maps' as folder, name as original, corrected from m union all select archive, 'expected', stem || '.png', new_stem || '.png' from m where has_image
 union all select e.archive, 'expected', e.name, e.name from {image_names} e where not exists (select 1 from m where m.archive = e.archive and m.stem || '.png' = e.name)""")
def naming_plan(t: Inputs) -> DataFrame:
    return naming.plan(t.map_names, t.image_names).select("archive", "folder", "original", "corrected")


@query("with " + _ORDERED + ", " + _KINDS + " select archive, kind, count(*) as n, row_number() over (partition by archive order by count(*) desc, kind) as place from z group by archive, kind")
def naming_summary(t: Inputs) -> DataFrame:
    return naming.summary(naming.plan(t.map_names, t.image_names)).select("archive", "kind", "n", F.col("place").cast("long").alias("place"))


@query("with " + _ORDERED + ", " + _KINDS + """, x as (select archive, name, string_agg(kind, '; ' order by case kind when 'no leading number' then 1 when 'leading number of the wrong width' then 2 when 'leading number out of sequence' then 3 when 'wrong separator after the leading number' then 4 else 5 end) as kinds, count(*) as n from r group by all)
 select m.archive, m.name as original, coalesce(x.kinds, '') as kinds, coalesce(x.n, 0) as n from m left join x on x.archive = m.archive and x.name = m.name""")
def naming_reasons(t: Inputs) -> DataFrame:
    maps = naming.plan(t.map_names, t.image_names).filter("folder = 'maps'")
    kinds = F.filter(F.transform("reasons", lambda r: r["kind"]), lambda k: k != naming.OTHER)
    return maps.select("archive", "original", F.array_join(kinds, "; ").alias("kinds"), F.size(kinds).cast("long").alias("n"))


@query("with " + _ORDERED + """ select archive, 'maps/' || name || ' has no reference image in expected/ (not fixable)' as line from m where not has_image
 union all select e.archive, 'expected/' || e.name || ' belongs to no map in maps/ (not fixable)' from {image_names} e where not exists (select 1 from m where m.archive = e.archive and m.stem || '.png' = e.name)""")
def naming_problems_unfixable(t: Inputs) -> DataFrame:
    return naming.problems(naming.plan(t.map_names, t.image_names)).filter("line like '%(not fixable)'")


@query("with " + _ORDERED + " select archive, name from m where not has_image")
def naming_missing(t: Inputs) -> DataFrame:
    return naming.missing(t.map_names, t.image_names)


@query("select e.archive, e.name from {image_names} e where not exists (select 1 from {map_names} m where m.archive = e.archive and regexp_replace(m.name, '\\.[ox]map$', '.png') = e.name)")
def naming_orphans(t: Inputs) -> DataFrame:
    return naming.orphans(t.image_names, t.map_names)


@query("select archive, name from {map_names} where contains(name, 'red') order by name")
def name_filter(t: Inputs) -> DataFrame:
    return t.map_names.filter(F.contains("name", F.lit("red"))).orderBy("name")


@query("select conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as escaped from {conversations}")
def text_xml_escape(t: Inputs) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.xml_escape(F.col("text")).alias("escaped"))


@query("""with w as (select conv_id, turn, l.i, l.line, list_filter(string_split(regexp_replace(l.line, '[\\s\\x0B]+', ' ', 'g'), ' '), lambda x: x <> '') as words
 from (select conv_id, turn, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': x})) as l from conversations) q)
 select conv_id, turn, string_agg(case when len(words) = 0 then '' else list_reduce(words, lambda a, x: case when length(regexp_extract(a, '[^\\n]*$')) + 1 + length(x) > 80 then a || chr(10) || x else a || ' ' || x end) end, chr(10) order by i) as wrapped from w group by conv_id, turn""".replace("{'i'", "{{'i'").replace("x}", "x}}").replace("{{", "{").replace("}}", "}"))
def text_wrap(t: Inputs) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.wrap(F.col("text")).alias("wrapped"))


@query("select page_id, case when contains(html, '<') then replace(replace(replace(replace(regexp_replace(html, '<[^>]*(>|$)|>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') else html end as plain from {pages}")
def text_plain(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", T.plain_text(F.col("html")).alias("plain"))


@query("select seq, code, array_to_string(list_transform(string_split(code, '.'), lambda x: cast(coalesce(try_cast(x as integer), 0) as varchar)), '.') as number from {symbols}")
def text_symbol_number(t: Inputs) -> DataFrame:
    return t.symbols.select("seq", "code", T.symbol_number(F.col("code")).alias("number"))


@query("select page_id, regexp_replace(url, '[^A-Za-z0-9.-]', '_', 'g') as safe from {pages}")
def text_safe_name(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", T.safe_name(F.col("url")).alias("safe"))


@query("""select seq, lpad(cast(seq + 1 as varchar), greatest(3, length(cast(seq + 1 as varchar)))::int, '0') || '_' || case symbol_type when 1 then 'point' when 2 then 'line' when 4 then 'area' when 8 then 'text' else 'combined' end
 || '_' || array_to_string(list_transform(string_split(code, '.'), lambda x: cast(coalesce(try_cast(x as integer), 0) as varchar)), '.') || '_' || regexp_replace(name, '[^A-Za-z0-9.-]', '_', 'g') as base from {symbols}""")
def text_sheet_name(t: Inputs) -> DataFrame:
    kind = F.col("symbol_type")
    named = F.when(kind == 1, "point").when(kind == 2, "line").when(kind == 4, "area").when(kind == 8, "text").otherwise("combined")
    return t.symbols.select("seq", T.sheet_name(F.col("seq") + 1, named, F.col("code"), F.col("name")).alias("base"))


@query("select name, regexp_extract(name, '(?i)^.+(\\.omap|\\.xmap|\\.png)$', 1) as suffix, regexp_replace(name, '(?i)\\.(omap|xmap|png)$', '') as stem, count(*) as n from {map_names} group by name")
def text_split_suffix(t: Inputs) -> DataFrame:
    stem, suffix = T.split_suffix(F.col("name"))
    return t.map_names.groupBy("name").agg(F.count("*").alias("n")).select("name", suffix.alias("suffix"), stem.alias("stem"), "n")


@query("select distinct stem, regexp_extract(stem, '^[0-9]*') as digits, regexp_extract(stem, '^[0-9]*([-_ ]*)', 1) as separator, regexp_extract(stem, '^[0-9]*[-_ ]*(.*)$', 1) as rest from {files}")
def text_split_ordinal(t: Inputs) -> DataFrame:
    digits, separator, rest = T.split_ordinal(F.col("stem"))
    return t.files.select("stem", digits.alias("digits"), separator.alias("separator"), rest.alias("rest")).distinct()


@query("select distinct stem, case when stem = '' then 'map' else replace(stem, ' ', '_') end as clean from {files}")
def text_no_space(t: Inputs) -> DataFrame:
    return t.files.select("stem", T.no_space(F.col("stem")).alias("clean")).distinct()


# sizes are multiples of a tenth of their unit, so that the shown decimal isn't a matter of rounding
_BYTES = "select o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey % 1000 when o_orderkey % 4 = 1 then (o_orderkey % 9000 + 10) * 100 when o_orderkey % 4 = 2 then (o_orderkey % 9000 + 10) * 100000 else (o_orderkey % 90000 + 10) * 100000000 end as size from {orders}"


@query(f"""with s as ({_BYTES}) select o_orderkey, case when size < 1000 then cast(size as varchar) || ' bytes' when size < 1000000 then cast(size // 1000 as varchar) || '.' || cast(size // 100 % 10 as varchar) || ' kB'
 when size < 1000000000 then cast(size // 1000000 as varchar) || '.' || cast(size // 100000 % 10 as varchar) || ' MB' else cast(size // 1000000000 as varchar) || '.' || cast(size // 100000000 % 10 as varchar) || ' GB' end as shown from s""")
def text_byte_size(t: Inputs) -> DataFrame:
    return t.sql(_BYTES).select("o_orderkey", T.byte_size(F.col("size")).alias("shown"))


@query("select o_orderkey, case when o_totalprice / 7 - 3000 < 0 then '??:??' else case when o_totalprice / 7 - 3000 >= 3600 then cast(cast(floor(o_totalprice / 7 - 3000) as bigint) // 3600 as varchar) || ':' else '' end || lpad(cast(cast(floor(o_totalprice / 7 - 3000) as bigint) // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(o_totalprice / 7 - 3000) as bigint) % 60 as varchar), 2, '0') end as clock from {orders}")
def text_clock(t: Inputs) -> DataFrame:
    return t.orders.select("o_orderkey", T.clock(F.col("o_totalprice") / 7 - 3000).alias("clock"))


_FRAGMENT = """select p_partkey, concat('<symbol type="16" id="', cast(p_partkey as varchar(20)), '" name="', p_name, '"><combined_symbol><part symbol="', cast(p_size as varchar(20)), '"/><part private="true"/><part symbol="x', cast(p_size as varchar(20)), '"/><part symbol="', cast(p_size * 3 - 30 as varchar(20)), '"/></combined_symbol></symbol>') as fragment, p_size from {part}"""


@query(f"with f as ({_FRAGMENT}) select p_partkey, [p_size, p_size * 3 - 30] as found from f")
def text_part_references(t: Inputs) -> DataFrame:
    return t.sql(_FRAGMENT).select("p_partkey", T.part_references(F.col("fragment")).alias("found"))


@query(f"with f as ({_FRAGMENT}) select p_partkey, replace(replace(replace(fragment, 'symbol=\"' || p_size || '\"', 'symbol=\"0\"'), 'symbol=\"x' || p_size || '\"', 'symbol=\"-1\"'), ' id=\"' || p_partkey || '\"', ' id=\"1\"') as text from f where p_size <> p_size * 3 - 30")
def text_renumbered(t: Inputs) -> DataFrame:
    mapping = F.create_map(F.col("p_size"), F.lit(0))
    return t.sql(_FRAGMENT).filter("p_size <> p_size * 3 - 30").select("p_partkey", T.renumbered(F.col("fragment"), F.lit(1), mapping).alias("text"))


_SETTINGS = """select o_orderkey, concat(case when o_orderkey % 5 = 0 then 'title' else 'resolution' end, '  ', case when o_orderkey % 3 = 0 then 'six' else cast(o_orderkey % 12 as varchar(10)) end, ' px/m', chr(10), ' resolution 7.5', chr(10), 'frame ', cast(o_custkey % 60 as varchar(10)), '.5', chr(10), chr(10), 'frame 9 in prose') as info from {orders}"""


@query(f"with s as ({_SETTINGS}) select o_orderkey, case when o_orderkey % 5 = 0 or o_orderkey % 3 = 0 then 7.5 else cast(o_orderkey % 12 as double) end as resolution, cast(string_split(string_split(info, 'frame ')[2], chr(10))[1] as double) as frame from s")
def archive_settings(t: Inputs) -> DataFrame:
    resolution, frame = T.settings(F.col("info"))
    return t.sql(_SETTINGS).select("o_orderkey", resolution.alias("resolution"), frame.alias("frame"))


_COORDS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(cast(l_partkey as varchar(20)), ' -', cast(l_suppkey as varchar(20)), case when l_linenumber % 2 = 0 then concat(' ', cast(l_linenumber as varchar(20))) else '' end, ';', chr(10), cast(l_orderkey as varchar(20)), ' ', case when l_partkey % 5 = 0 then '1.5' else '7' end, ' 18;', cast(l_suppkey as varchar(20)), ' 3;') as coords from {lineitem}"""


@query(f"with c as ({_COORDS}) select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 5 = 0 then 1 else 3 end as n, l_partkey + case when l_partkey % 5 = 0 then 0 else l_orderkey + l_suppkey end as sx, -l_suppkey + case when l_partkey % 5 = 0 then 0 else 10 end as sy, case when l_linenumber % 2 = 0 then l_linenumber else 0 end + case when l_partkey % 5 = 0 then 0 else 18 end as sf from c")
def coordinate_parse(t: Inputs) -> DataFrame:
    found = T.with_coordinates(t.sql(_COORDS), "coords", "c")
    total = lambda f: F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("c").alias("n"), total("x").alias("sx"), total("y").alias("sy"), total("flags").alias("sf"))
