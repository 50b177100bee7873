"""The queries of :mod:`tesselle.plans.registry` in DuckDB SQL, written independently of them."""

from __future__ import annotations

from tesselle.functions.text import AREA_SUFFIXES, STATE_FIPS, STATE_NAMES

_WEIGHTS = "(values ('assr_impr_ppsf', 1.5), ('assr_land_ppsf', 1.5), ('assr_market_value', 0.5))"


def _round(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


_POSITIONS = """pos as (select o_orderkey as parcel_id, cast((o_orderkey * 7919) % 9973 + 10000 * (o_orderkey // 12000) as double) as px, cast((o_orderkey * 104729) % 9967 as double) as py from orders)"""
_PLACED = _POSITIONS + """,
 placed as (select parcel_id, px, py, cast(floor(px / 1000) * 10 + floor(py / 1000) as bigint) as tile_id, cast(floor(px / 2500) * 4 + floor(py / 2500) as bigint) as nid from pos)"""
_DERIVED = _PLACED + """,
 area as (select l_orderkey as parcel_id, sum(l_quantity) as q, max(l_extendedprice) as e from lineitem group by 1),
 derived as (
   select p.*, o.o_totalprice as assr_market_value, a.q as bldg_area_finished_sqft, a.e as land_area_sqft,
          case when a.q > 0 then o.o_totalprice / a.q end as assr_impr_ppsf, case when a.e > 0 then o.o_totalprice / a.e end as assr_land_ppsf
   from placed p join orders o on o.o_orderkey = p.parcel_id left join area a using (parcel_id))"""
_FIELDS = ("assr_impr_ppsf", "assr_land_ppsf", "assr_market_value")
_AT = "[" + ", ".join(f"{i}/30.0::double" for i in range(31)) + "]"
_TENTHS = "[" + ", ".join(f"{i}/10.0::double" for i in range(11)) + "]"
_BINNED = (
    _DERIVED
    + ", edge as (select "
    + ", ".join(f"list_sort(list_distinct(quantile_cont({f}, {_AT}))) as e_{f}" for f in _FIELDS)
    + " from derived), binned as (select parcel_id, tile_id, nid, "
    + ", ".join(f"case when {f} is not null and len(e_{f}) >= 2 then cast(greatest(len(list_filter(e_{f}, lambda z : z < {f})) - 1, 0) as integer) end as {f}_binned" for f in _FIELDS)
    + " from derived, edge)"
)
_CODES = (
    _BINNED
    + ", long as ("
    + " union all ".join(f"select parcel_id, tile_id, nid, '{f}' as field, {f}_binned as v from binned" for f in _FIELDS)
    + """),
 kind as (select field, bool_or(v is null) as gaps, min(v) as lo from long group by field),
 ranked as (select field, v, dense_rank() over (partition by field order by v nulls first) - 1 as r from (select distinct field, v from long)),
 code as (
   select parcel_id, tile_id, nid, l.field, cast(case when gaps then r else l.v - lo end as integer) as code
   from long l join kind using (field) join ranked r on r.field = l.field and r.v is not distinct from l.v)"""
)


def _mi(counts: str, sizes: str, key: str, exact: bool = False) -> str:
    """A query of (key, n, score) from CTEs counts(key, field, code, c) and sizes(key, n)."""
    keys = [k.strip() for k in key.split(",")]
    on = " and ".join(f"c.{k} = s.{k}" for k in keys)
    own = ", ".join(f"s.{k}" for k in keys)
    if exact:
        base = f"select {own}, s.n, b.everywhere, b.weight, coalesce(c.c, 0) as inside from {sizes} s cross join bins b left join {counts} c on {on} and c.field = b.field and c.code = b.code"
    else:
        base = f"select {own}, s.n, b.everywhere, b.weight, c.c as inside from {sizes} s join {counts} c on {on} join bins b on b.field = c.field and b.code = c.code"
    term = "case when {c} > 0 then {c} * (ln({c}) + ln(g) - ln({m}) - ln(everywhere)) else 0 end"
    inside, outside = term.format(c="inside", m="n"), term.format(c="(everywhere - inside)", m="(g - n)")
    guard = "case when n >= g or n <= 1 then 0 else {x} end"
    return f"""select {own}, s.n, case when s.n <= 0 then 2.0 when s.n = 1 then 1.0 when s.n >= g then 0.0 else coalesce(t.x, 0) / g end as score
      from {sizes} s cross join total left join (select {key}, sum(weight * ({guard.format(x=f"({inside}) + ({outside})")})) as x from ({base}) q cross join total group by {key}) t on {" and ".join(f"t.{k} = s.{k}" for k in keys)}"""


_SCORED = (
    _CODES
    + f""",
 total as (select count(*) as g from placed),
 overall as (select field, code, count(*) as c from code group by all),
 bins as (select field, code, c as everywhere, weight from overall join {_WEIGHTS} w(field, weight) using (field)),
 cin as (select nid, field, code, count(*) as c from code group by all),
 nsize as (select nid, count(*) as n from placed group by nid)"""
)
_SCORES = _SCORED + ", score as (" + _mi("cin", "nsize", "nid") + ")"

_LATTICE = _POSITIONS + """,
 lat as (select parcel_id, cast(floor(px / 500) * 100 + floor(py / 500) as bigint) as tile_id, cast(floor(px / 4000) * 3 + floor(py / 4000) as bigint) as nid from pos),
 lt as (select distinct tile_id, tile_id // 100 as i, tile_id % 100 as j from lat),
 le as (select a.tile_id as src, b.tile_id as dst from lt a join lt b on a.i // 5 = b.i // 5 and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.tile_id < b.tile_id)"""
_COMPONENTS = _LATTICE + """,
 both_ways as (select src, dst from le union all select dst, src from le),
 reach as (select tile_id as v, tile_id as r from lt union select b.dst as v, reach.r from reach join both_ways b on b.src = reach.v),
 comp as (select v as tile_id, min(r) as component from reach group by v)"""
_SIZES = _COMPONENTS + """,
 per as (select tile_id, count(*) as n from lat group by tile_id),
 size as (select component, count(*) as tiles, sum(n)::bigint as parcels from comp join per using (tile_id) group by component)"""
_PIECES = _LATTICE + """,
 tl as (select tile_id, arg_min(nid, parcel_id) as nid, count(*) as parcels, count(distinct nid) > 1 as mixed from lat group by tile_id),
 ie as (select src, dst, a.nid from le join tl a on a.tile_id = src join tl b on b.tile_id = dst where a.nid = b.nid),
 iw as (select src, dst, nid from ie union all select dst, src, nid from ie)"""
_PIECE_COUNT = _PIECES + """,
 r(v, c) as (select tile_id, tile_id from tl union select iw.dst, r.c from r join iw on iw.src = r.v),
 pieces as (select nid, count(distinct c) as pieces from (select v, min(c) as c from r group by v) m join tl on tl.tile_id = v group by nid)"""
_GROUPED = _SIZES + """,
 heavy as (select component, parcels, row_number() over (order by parcels desc, component) as k from size where parcels > 0),
 lpt(k, component, g, a, b, c) as (
   select 0::bigint, null::bigint, null::bigint, 0::hugeint, 0::hugeint, 0::hugeint
   union all
   select h.k, h.component, case when a <= b and a <= c then 0 when b <= c then 1 else 2 end,
          a + case when a <= b and a <= c then h.parcels else 0 end, b + case when not (a <= b and a <= c) and b <= c then h.parcels else 0 end,
          c + case when not (a <= b and a <= c) and not b <= c then h.parcels else 0 end
   from lpt join heavy h on h.k = lpt.k + 1),
 grouped as (select component, g as group_id from lpt where k > 0)"""
_COARSE = _PLACED + """,
 ct as (select distinct tile_id, tile_id // 10 as i, tile_id % 10 as j from placed),
 ce as (select a.tile_id as src, b.tile_id as dst from ct a join ct b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.tile_id < b.tile_id),
 lab as (select tile_id, arg_min(nid, parcel_id) as nid, count(*) as parcels, count(distinct nid) > 1 as mixed from placed group by tile_id),
 border as (
   select src as i, dst as j from ce join lab a on a.tile_id = src join lab b on b.tile_id = dst where a.nid <> b.nid
   union all select tile_id, tile_id from lab where mixed)"""
_MOVES = (
    _SCORED
    + _COARSE.removeprefix(_PLACED)
    + """,
 delta as (select tile_id, field, code, count(*) as cnt from code group by all),
 pair as (select i, j, a.nid as ni, b.nid as nj, a.parcels as pi, b.parcels as pj from border join lab a on a.tile_id = i join lab b on b.tile_id = j where i <> j),
 give as (select distinct * from (select i as tile, ni as n1, nj as n2, pi as parcels from pair union all select j, nj, ni, pj from pair)),
 now as ("""
    + _mi("cin", "nsize", "nid")
    + ")"
)


def _gain(sides: str) -> str:
    """CTEs from shift(cand, nid, shift) and part(cand, nid, tile_id, sign) to gain(cand, gain)."""
    return (
        sides
        + """,
 after_c as (
   select cand, nid, field, code, sum(c) as c from (
     select cand, nid, field, code, c from shift join cin using (nid)
     union all select cand, nid, field, code, sign * cnt from part join delta using (tile_id)) group by all having sum(c) <> 0),
 after_n as (select cand, nid, n + shift as n from shift join nsize using (nid)),
 then_s as ("""
        + _mi("after_c", "after_n", "cand, nid")
        + """),
 gain as (select cand, sum(t.score - now.score) as gain from then_s t join now using (nid) group by cand)"""
    )


_REFUSED = """
 rinner as (select src, dst, a.nid from ce join lab a on a.tile_id = src join lab b on b.tile_id = dst where a.nid = b.nid),
 rboth as (select src, dst, nid from rinner union all select dst, src, nid from rinner),
 rpair as (select i, j, a.nid as ni, b.nid as nj from border join lab a on a.tile_id = i join lab b on b.tile_id = j where i <> j),
 rside as (select 's:' || i || ':' || j as cand, i as tile, ni as own, j as other, nj as goal from rpair union all select 's:' || i || ':' || j, j, nj, i, ni from rpair
           union all select 'd:' || i || ':' || nj, i, ni, null, null from rpair union all select 'd:' || j || ':' || ni, j, nj, null, null from rpair),
 rnear as (select distinct tile, dst as v from rside join rboth on rboth.src = tile and rboth.nid = own),
 rwalk(tile, v) as (select tile, min(v) from rnear group by tile union select rwalk.tile, rboth.dst from rwalk join rboth on rboth.src = rwalk.v where rboth.dst <> rwalk.tile),
 rsplit as (select distinct tile from rnear n where not exists (select 1 from rwalk w where w.tile = n.tile and w.v = n.v)),
 rall as (select src, dst from ce union all select dst, src from ce),
 ralone as (select cand from rside s where other is not null and not exists (select 1 from rall join lab on lab.tile_id = rall.dst where rall.src = s.tile and rall.dst <> s.other and lab.nid = s.goal)),
 refused as (select distinct cand from (select cand from rside where tile in (select tile from rsplit) union all select cand from ralone))"""
_DONATE = _MOVES + _gain("""
 , dcand as (select 'd:' || tile || ':' || n2 as cand, * from give),
 shift as (select cand, n1 as nid, -parcels as shift from dcand union all select cand, n2, parcels from dcand),
 part as (select cand, n1 as nid, tile as tile_id, -1 as sign from dcand union all select cand, n2, tile, 1 from dcand)""")
_SWAP = _MOVES + _gain("""
 , scand as (select 's:' || i || ':' || j as cand, * from pair),
 shift as (select cand, ni as nid, pj - pi as shift from scand union all select cand, nj, pi - pj from scand),
 part as (select cand, ni as nid, i as tile_id, -1 as sign from scand union all select cand, ni, j, 1 from scand
          union all select cand, nj, j, -1 from scand union all select cand, nj, i, 1 from scand)""")

_BOXES = _POSITIONS + ", box as (select parcel_id as id, px - 25 as x0, py - 25 as y0, px + 25 as x1, py + 25 as y1 from pos)"
_DIST = "sqrt(pow(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + pow(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2))"
_NEAR = _BOXES + f", near as (select a.id as src, b.id as dst, {_DIST} as distance, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1 from (select *, unnest([floor(x0 / 400) - 1, floor(x0 / 400), floor(x0 / 400) + 1]) as cell from box) a join box b on floor(b.x0 / 400) = a.cell and a.id < b.id and b.x0 <= a.x1 + 100 and b.x1 >= a.x0 - 100 and b.y0 <= a.y1 + 100 and b.y1 >= a.y0 - 100 where {_DIST} <= 100)"


def _ends(c: str) -> str:
    a0, a1, b0, b1 = f"a{c}0", f"a{c}1", f"b{c}0", f"b{c}1"
    middle = f"(greatest({a0}, {b0}) + least({a1}, {b1})) / 2"
    return f"case when {a1} < {b0} then {a1} when {b1} < {a0} then {a0} else {middle} end as p{c}, case when {a1} < {b0} then {b0} when {b1} < {a0} then {b1} else {middle} end as q{c}"


_SIGHT = (
    _NEAR
    + f""",
 line0 as (select src, dst, distance, {_ends("x")}, {_ends("y")} from near where distance > 1e-6),
 line as (select src, dst, px + k * (qx - px) as px, py + k * (qy - py) as py, qx + k * (px - qx) as qx, qy + k * (py - qy) as qy from (select *, least(0.5, 0.25 * distance) / distance as k from line0)),
 blocked as (
   select distinct src, dst from (select *, unnest([floor(least(px, qx) / 400) - 1, floor(least(px, qx) / 400), floor(least(px, qx) / 400) + 1]) as cell from line) l join box o
     on floor(o.x0 / 400) = l.cell and o.x0 <= greatest(px, qx) and o.x1 >= least(px, qx) and o.y0 <= greatest(py, qy) and o.y1 >= least(py, qy)
   where (px <> qx or px between o.x0 and o.x1) and (py <> qy or py between o.y0 and o.y1)
     and greatest(0, case when px <> qx then least((o.x0 - px) / (qx - px), (o.x1 - px) / (qx - px)) else 0 end, case when py <> qy then least((o.y0 - py) / (qy - py), (o.y1 - py) / (qy - py)) else 0 end)
      <= least(1, case when px <> qx then greatest((o.x0 - px) / (qx - px), (o.x1 - px) / (qx - px)) else 1 end, case when py <> qy then greatest((o.y0 - py) / (qy - py), (o.y1 - py) / (qy - py)) else 1 end))"""
)
_GAPPED = _PLACED + """,
 tile as (select tile_id as id, tile_id // 10 as i, tile_id % 10 as j, case when (tile_id // 10 + tile_id % 10) % 2 = 1 and tile_id % 3 = 0 then 40.0 else 0.0 end as cut from (select distinct tile_id from placed)),
 gt as (select id, i * 1000.0 as x0, j * 1000.0 as y0, (i + 1) * 1000.0 - cut as x1, (j + 1) * 1000.0 - cut as y1 from tile)"""
_CLASSED = _GAPPED + f""",
 close as (select a.id as src, b.id as dst, {_DIST} as distance, least(a.x1, b.x1) - greatest(a.x0, b.x0) as ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) as oy, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1 from gt a join gt b on a.id < b.id where {_DIST} <= 50),
 cls as (select src, dst, case when distance > 1e-9 then 'gap' when (case when ox > 0 and oy > 0 then 2 * (ox + oy) else greatest(ox, oy, 0) end) > 1 then 'rook' else 'corner' end as edge_class, case when distance > 1e-9 then distance else 0.0 end as gap_ft from close)"""
_INNER = _CLASSED + """,
 board as (select id as tile_id, ((id // 10 + id % 10) % 3)::bigint as nid from gt),
 inner_e as (select src, dst, edge_class, a.nid from cls join board a on a.tile_id = src join board b on b.tile_id = dst where a.nid = b.nid)"""


def _pieces(name: str, kinds: str) -> str:
    return f"""(with recursive w as (select src, dst from inner_e where edge_class in ({kinds}) union all select dst, src from inner_e where edge_class in ({kinds})),
       r(v, c) as (select tile_id, tile_id from board union select w.dst, r.c from r join w on w.src = r.v)
       select nid, count(distinct c) as pieces, '{name}' as accepted from (select v, min(c) as c from r group by v) m join board on board.tile_id = m.v group by nid)"""


_GRID = "(select -120.0 as xmin, 30.0 as ymin, 1950.0 as xmax, 1210.0 as ymax)"
_RELABELS = "rel as (select event_id // 100 as iteration, user_id as parcel from events)"
_TRAILING = _RELABELS + """,
 mark as (select distinct iteration from rel),
 trail as (select m.iteration, count(*) as events, count(distinct parcel) as distinct_parcels from mark m join rel r on r.iteration between m.iteration - 4 and m.iteration group by m.iteration)"""
_CHECKPOINTS = "(values " + ", ".join(f"('{r}', {i}, {f})" for r, i, f in [("r1", i * 100, False) for i in range(1, 8)] + [("r1", 700, True), ("r2", 50, False), ("r2", 60, False), ("r3", 10, True)]) + ") c(run_id, iteration, is_final)"


def _values(items: list[str], name: str) -> str:
    quoted = ", ".join("('" + v.replace("'", "''") + "')" for v in items)
    return f"(values {quoted}) t({name})"


def _alternatives(words) -> str:
    return "|".join(w.replace(".", "\\.") for w in sorted(words, key=lambda w: (-len(w), w)))


_STATES = "st as (select * from (values " + ", ".join([f"('{c.lower()}', '{f}', true)" for c, f in STATE_FIPS.items()] + [f"('{n}', '{STATE_FIPS[c]}', false)" for n, c in STATE_NAMES.items()]) + ") s(form, fips, short))"
_PLACES = "(values ('Leesburg city', 'Leesburg', '12', 40.0), ('Lee CDP', 'Lee', '12', 3.0), ('Lee County', 'Lee', '12', 800.0), ('Lee County', 'Lee', '01', 600.0), ('Leeds city', 'Leeds', '01', 22.0), ('Fort Myers city', 'Fort Myers', '12', 49.0), ('Fort Myers Beach town', 'Fort Myers Beach', '12', 6.0), ('Upper Lee village', 'Upper Lee', '12', 2.0)) p(name, basename, state, area)"
_QUERIES = ["Fort Myers, FL", "Lee County Florida", "Charleston West Virginia", "Bonita Springs FL", "Cape Coral", "Paris, Texas", "Lake, Of, The Woods, mn", "  Reno  ", "FL"]
_NAMES = ["Lee County", "Iosco charter township", "Valdez-Cordova Census Area", "Chicago", "County", "Juneau City and Borough", "Carson City", "  Bristol town  ", "Nashville metropolitan government county"]
_RESPONSES = "(values (1, 200, null), (2, 200, 'runtime error: Query timed out'), (3, 429, null), (4, 503, ''), (5, 504, null), (6, 400, null), (7, 200, 'ok'), (8, 200, 'Too Many rows')) r(id, status, remark)"
_HINT = "regexp_matches(lower(coalesce(remark, '')), 'timed out|out of memory|too many|exceeded')"

ORACLES: dict[str, str] = {
    "derived_ratio": f"with {_DERIVED} select parcel_id, {_round('assr_impr_ppsf')} as assr_impr_ppsf, {_round('assr_land_ppsf')} as assr_land_ppsf from derived",
    "filter_string_eq": "select p_partkey, p_size from part where cast(p_size as varchar) = '15'",
    "coerce_numeric": "select p_partkey, try_cast(regexp_replace(p_brand, '^Brand#', '') as double) as brand_number, try_cast(p_type as double) as type_number from part",
    "qcut_bins": f"with {_BINNED} select * from binned",
    "bin_codes": f"with {_CODES} select parcel_id, field, code from code",
    "field_universe": "select * from (values ('assr_market_value', 'numeric'), ('bldg_area_finished_sqft', 'numeric'), ('land_area_sqft', 'numeric'), ('parcel_id', 'numeric'), ('px', 'numeric'), ('py', 'numeric'), ('assr_impr_ppsf', 'derived'), ('assr_land_ppsf', 'derived')) f(name, kind)",
    "validate_config": "select * from (values ('parcel_filter_column', 'model_grp', true), ('land_class_column', 'land_class', false), ('continuous_variables', 'nowhere', true), ('seed_fields', 'nowhere_else', true), ('weights', 'land_area_sqft_binned', true), ('weights', 'ghost_binned', true)) p(setting, value, fatal)",
    "distinct_values_topk": "select p_type as value, count(*) as n from part where p_type is not null group by p_type order by n desc, value limit 20",
    "transparent_classes": "select land_class, coalesce(regexp_matches(lower(land_class), 'right-of-way|right of way|row|submerged|river|lake|canal|ditch|drain|waterway|utility|subsurface|sewage|waste land|common element|common area|street|road|highway|easement'), false) as transparent from (values ('SINGLE FAMILY RESIDENTIAL'), ('RIGHT-OF-WAY'), ('Road R/W'), ('RIVERS, LAKES, SUBMERGED LAND'), ('VACANT AGRICULTURAL'), ('utility easement'), ('CROWN LAND'), (null)) l(land_class)",
    "clip_within_box": f"with {_POSITIONS} select parcel_id from pos where px > 1000 and px < 4000 and py > 2000 and py < 9000",
    "clip_within_polygon": f"""with {_POSITIONS}, side as (select * from (values (1000, 1000, 9000, 2000), (9000, 2000, 5000, 9000), (5000, 9000, 1000, 1000), (4000, 3000, 5000, 3000), (5000, 3000, 5000, 4000), (5000, 4000, 4000, 4000), (4000, 4000, 4000, 3000)) s(x0, y0, x1, y1)),
        t as (select parcel_id, sum(((y0 > py) <> (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0)::double + x0)::int) as crossings,
                     bool_or((x1 - x0) * (py - y0) = (y1 - y0) * (px - x0) and px between least(x0, x1) and greatest(x0, x1) and py between least(y0, y1) and greatest(y0, y1)) as on_border
              from pos, side group by parcel_id)
        select parcel_id from t where crossings % 2 = 1 and not on_border""",
    "bounds_aggregate": f"with {_POSITIONS} select min(px) as xmin, min(py) as ymin, max(px) as xmax, max(py) as ymax from pos",
    "viewport_count": f"with {_PLACED} select count(*) as visible, count(distinct tile_id) as tiles from placed where px between 2000 and 6000 and py between 1000 and 3000",
    "median_impute": f"with {_DERIVED}, m as (select median(assr_impr_ppsf) as a, median(bldg_area_finished_sqft) as b from derived) select parcel_id, {_round('coalesce(assr_impr_ppsf, a)')} as assr_impr_ppsf, {_round('coalesce(bldg_area_finished_sqft, b)')} as bldg_area_finished_sqft from derived, m",
    "hist_global": f"with {_CODES} select field, code, count(*) as c from code group by all",
    "hist_by_neighborhood": f"with {_CODES} select nid, field, code, count(*) as c from code group by all",
    "totals": f"with {_PLACED} select nid, count(*) as n from placed group by nid",
    "tile_delta": f"with {_CODES} select tile_id, field, code, count(*) as cnt from code group by all",
    "mi_score": f"with {_SCORES} select nid, n, {_round('score')} as score from score",
    "mi_score_exact": f"with {_SCORED}, score as ({_mi('cin', 'nsize', 'nid', True)}) select nid, n, {_round('score')} as score from score",
    "weighted_score": f"with {_SCORES} select {_round('sum(score * n)', 4)} as num, sum(n)::bigint as den, {_round('sum(score * n) / sum(n)')} as weighted_score from score",
    "mean_score": f"with {_SCORES}, ids as (select unnest(generate_series(0, (select max(nid) from score))) as nid) select count(*) as labels, count(score) as active, {_round('avg(coalesce(score, 2.0))')} as mean_score from ids left join score using (nid)",
    "grid_cells": f"select i || ':' || j as cell, i * 500.0 as x0, j * 500.0 as y0, (i + 1) * 500.0 as x1, (j + 1) * 500.0 as y1 from (select unnest(generate_series(floor(xmin / 500)::int, ceil(xmax / 500)::int - 1)) as i, ymin, ymax from {_GRID}) a, lateral (select unnest(generate_series(floor(ymin / 500)::int, ceil(ymax / 500)::int - 1)) as j) b",
    "grid_lines": "select i * 500.0 as x0, 0.0 as y0, i * 500.0 as x1, 1500.0 as y1 from range(-1, 5) t(i) union all select -500.0, j * 500.0, 2000.0, j * 500.0 from range(0, 4) u(j)",
    "shatter_tiles": f"with {_POSITIONS} select area_id, k as tile_id, case when k < 90 then 1000000.0 else 500000.0 end as sqft from (select distinct floor(px / 10000)::bigint as area_id from pos) a, range(0, 100) t(k)",
    "water_clip": f"with {_COARSE} select tile_id, (1000000.0 - case when i % 10 = 2 then 200000.0 else 0.0 end - coalesce(pow(100 + 50 * (s_suppkey % 5), 2), 0))::double as sqft from ct left join supplier on s_suppkey = tile_id",
    "point_in_tile": f"with {_GAPPED} select parcel_id, min(id) as tile_id from pos left join gt on px > x0 and px < x1 and py > y0 and py < y1 group by parcel_id",
    "virtual_tiles": f"with {_GAPPED}, seat as (select parcel_id, min(id) as tile_id from pos left join gt on px > x0 and px < x1 and py > y0 and py < y1 group by parcel_id) select parcel_id, tile_id, false as is_virtual from seat where tile_id is not null union all select parcel_id, (select max(tile_id) from seat) + row_number() over (order by parcel_id), true from seat where tile_id is null",
    "populated_tiles": f"with {_POSITIONS} select distinct floor(px / 1000)::int || ':' || floor(py / 1000)::int as cell from pos",
    "dwithin_boxes": f"with {_NEAR} select src, dst, {_round('distance')} as distance from near",
    "los_edges": f"with {_SIGHT} select src, dst from near where distance <= 1e-6 union all select src, dst from line l where not exists (select 1 from blocked k where k.src = l.src and k.dst = l.dst)",
    "tile_lift": f"with {_NEAR}, placed as (select parcel_id, cast(floor(px / 1000) * 10 + floor(py / 1000) as bigint) as tile_id from pos) select distinct least(a.tile_id, b.tile_id) as src, greatest(a.tile_id, b.tile_id) as dst from near join placed a on a.parcel_id = src join placed b on b.parcel_id = dst where a.tile_id <> b.tile_id",
    "adjacency_isolates": f"with {_LATTICE} select tile_id, count(dst) as neighbours from lt left join (select src, dst from le union all select dst, src from le) e on e.src = tile_id group by tile_id",
    "obstacles_by_mode": f"with {_POSITIONS} select 'modeled' as mode, count(*) as obstacles from pos where parcel_id % 2 = 0 union all select 'all', count(*) from pos union all select 'all_except', count(*) from pos where parcel_id % 10 <> 0",
    "nearest_tile": f"with {_BOXES}, q as (select * from (values (0, 700.0, 700.0), (1, 5000.0, 5000.0), (2, 9990.0, 10.0)) q(query, x, y)), n as (select query, id, sqrt(pow(greatest(0, x0 - x, x - x1), 2) + pow(greatest(0, y0 - y, y - y1), 2)) as distance from q, box) select query, id, {_round('distance')} as distance from n where distance <= 400 qualify row_number() over (partition by query order by n.distance, id) = 1",
    "adjacency_modes": f"""with {_SIGHT}, {_GAPPED.removeprefix(_POSITIONS + ',')},
        seen as (select src, dst from near where distance <= 1e-6 union all select src, dst from line l where not exists (select 1 from blocked k where k.src = l.src and k.dst = l.dst))
        select distinct least(a.tile_id, b.tile_id) as src, greatest(a.tile_id, b.tile_id) as dst, 'sight' as rule from seen join placed a on a.parcel_id = src join placed b on b.parcel_id = dst where a.tile_id <> b.tile_id
        union all select distinct least(a.tile_id, b.tile_id), greatest(a.tile_id, b.tile_id), 'near' from near join placed a on a.parcel_id = src join placed b on b.parcel_id = dst where a.tile_id <> b.tile_id
        union all select a.id, b.id, 'tile' from gt a join gt b on a.id < b.id where {_DIST} <= 100""",
    "tiles_from_cache": f"""with {_BOXES}, {_GAPPED.removeprefix(_POSITIONS + ',')},
        lone as (select parcel_id from pos where not exists (select 1 from gt where px > x0 and px < x1 and py > y0 and py < y1))
        select id, x0, y0, x1, y1 from gt
        union all select (select max(gt.id) from gt where exists (select 1 from pos where px > x0 and px < x1 and py > y0 and py < y1)) + row_number() over (order by parcel_id), x0, y0, x1, y1 from lone join box on box.id = parcel_id""",
    "parcel_scan": f"""with {_DERIVED}, own as (select d.* from derived d join orders o on o.o_orderkey = parcel_id where o_orderstatus = 'F' and px > 1000 and py > 500 and py < 9000),
        edge as (select list_sort(list_distinct(quantile_cont(assr_market_value, {_TENTHS}))) as m, list_sort(list_distinct(quantile_cont(assr_impr_ppsf, {_TENTHS}))) as i from own)
        select parcel_id, {_round('px')} as px, {_round('py')} as py, cast(greatest(len(list_filter(m, lambda z : z < assr_market_value)) - 1, 0) as integer) as assr_market_value_binned,
               case when assr_impr_ppsf is not null then cast(greatest(len(list_filter(i, lambda z : z < assr_impr_ppsf)) - 1, 0) as integer) end as assr_impr_ppsf_binned from own, edge""",
    "json_lines": f"""with {_POSITIONS} select parcel_id, 0 as line, case when parcel_id % 3 = 0 then 5 else 3 end as points, {_round('px - 25')} as lon, {_round('py - 25')} as lat from pos where parcel_id % 3 < 2
        union all select parcel_id, line, points, {_round('px + dx')}, {_round('py + dx')} from pos, (values (0, 3, -25.0), (1, 5, -10.0), (2, 3, 25.0)) m(line, points, dx) where parcel_id % 3 = 2""",
    "json_polygons": f"with {_POSITIONS} select parcel_id, 0 as part, case when parcel_id % 3 = 0 then 2500.0 else 2100.0 end::double as sqft from pos where parcel_id % 3 <> 1",
    "transparent_report": "select p_name as value, count(*) as n from part where p_name ilike '%ring%' or p_name ilike '%bolt%' group by p_name order by n desc, value limit 12",
    "owned_labels": f"with {_PIECES} select nid, count(*) as tiles from tl group by nid",
    "union_dedupe": f"with {_BOXES}, {_GAPPED.removeprefix(_POSITIONS + ',')} select x0, y0, x1, y1 from box union select x0, y0, x1, y1 from gt",
    "states_for_bounds": "select * from (values ('12'), ('13'), ('01')) s(state)",
    "crs_choice": "select arg_min(crs, area * case when nad27 then 10 else 1 end) as crs from (values ('EPSG:2236', 90.0, false), ('EPSG:2237', 80.0, false), ('EPSG:26759', 12.0, true), ('EPSG:6438', 95.0, false)) c(crs, area, nad27)",
    "connected_components": f"with recursive {_COMPONENTS} select tile_id as node, component from comp where tile_id in (select src from le union select dst from le)",
    "component_sizes": f"with recursive {_SIZES} select * from size",
    "component_summary": f"with recursive {_SIZES} select count(*) as components, sum(parcels)::bigint as parcels, max(parcels) as largest, {_round('sum(parcels) / max(parcels)')} as ceiling from size",
    "parcel_component": f"with recursive {_COMPONENTS} select parcel_id, component from lat join comp using (tile_id)",
    "split_labels": f"with recursive {_COMPONENTS} select parcel_id, nid, component, dense_rank() over (order by nid, component) - 1 as split from lat join comp using (tile_id)",
    "spanning": f"with recursive {_COMPONENTS} select nid, count(distinct component) as components from lat join comp using (tile_id) group by nid having count(distinct component) > 1",
    "label_pieces": f"with recursive {_PIECE_COUNT} select nid, pieces from pieces",
    "worst_labels": f"with recursive {_PIECE_COUNT} select nid, pieces from pieces where pieces > 1 order by pieces desc, nid limit 5",
    "lpt_groups": f"with recursive {_GROUPED} select component, group_id from grouped",
    "group_loads": f"with recursive {_GROUPED} select group_id, count(*) as components, sum(parcels)::bigint as parcels from grouped join size using (component) group by group_id",
    "articulation_test": f"""with recursive {_PIECES},
        edge as (select src, dst, a.nid as ns, b.nid as nd from le join tl a on a.tile_id = src join tl b on b.tile_id = dst where a.nid <> b.nid),
        give as (select distinct src as tile, ns as n1, nd as n2 from edge union select dst, nd, ns from edge),
        leaver as (select distinct tile, n1 from give),
        near as (select tile, dst as v from leaver join iw on iw.src = tile and iw.nid = n1),
        r(tile, v) as (select tile, min(v) from near group by tile union select r.tile, iw.dst from r join iw on iw.src = r.v where iw.dst <> r.tile),
        split as (select distinct tile from near where not exists (select 1 from r where r.tile = near.tile and r.v = near.v))
        select 'd:' || tile || ':' || n2 as cand, tile from give where tile in (select tile from split)""",
    "worker_count": f"with recursive {_SIZES} select cast(greatest(1, least(floor(sum(parcels) / max(parcels) + 0.5), count(*), 8)) as integer) as workers from size",
    "mixed_tiles": f"with {_COARSE} select tile_id, nid, parcels from lab where mixed",
    "boundary_edges": f"with {_COARSE} select i, j from border",
    "donation_gain": f"with {_DONATE} select cand, {_round('gain')} as gain from gain",
    "swap_gain": f"with {_SWAP} select cand, {_round('gain')} as gain from gain",
    "best_move": f"""with d as (with {_DONATE} select cand, 'donation' as kind, n1, n2, gain from gain join dcand using (cand)), s as (with {_SWAP} select cand, 'swap' as kind, ni as n1, nj as n2, gain from gain join scand using (cand)),
        a as (select cand, kind, least(n1, n2) % 4 as batch, round(gain, 9) + 0.0 as gain from (select * from d union all select * from s))
        select batch, cand, kind, {_round('gain')} as gain from a qualify row_number() over (partition by batch order by a.gain desc, cand) = 1""",
    "refused_moves": f"with recursive {_COARSE}, {_REFUSED} select cand from refused",
    "legal_move": f"""with recursive {_COARSE}, {_REFUSED}, d as (with {_DONATE} select cand, 'donation' as kind, n1, n2, gain from gain join dcand using (cand)), s as (with {_SWAP} select cand, 'swap' as kind, ni as n1, nj as n2, gain from gain join scand using (cand)),
        a as (select cand, kind, least(n1, n2) % 4 as batch, round(gain, 9) + 0.0 as gain from (select * from d union all select * from s) where cand not in (select cand from refused))
        select batch, cand, kind, {_round('gain')} as gain from a qualify row_number() over (partition by batch order by a.gain desc, cand) = 1""",
    "island_test": f"""with {_COARSE}, way as (select 's:' || i || ':' || j as cand, i, j, a.nid as ni, b.nid as nj from border join lab a on a.tile_id = i join lab b on b.tile_id = j where i <> j),
        side as (select cand, ni as nid, i as leaving, j as arriving from way union all select cand, nj, j, i from way),
        nb as (select src as t, dst as o from ce union all select dst, src from ce)
        select cand, nid, arriving from side s where not exists (select 1 from nb join lab on lab.tile_id = nb.o where nb.t = s.arriving and nb.o <> s.leaving and lab.nid = s.nid)""",
    "consolidate_jacobi": f"""with {_SCORED}, held as (select tile_id, nid, count(*) as own from placed group by all),
        way as (select tile_id || ':' || nid as cand, tile_id, nid, total_own - own as shift from (select *, sum(own) over (partition by tile_id) as total_own, count(*) over (partition by tile_id) as k from held) where k > 1),
        after_c as (select cand, nid, field, code, sum(c) as c from (
            select cand, nid, field, code, c from way join cin using (nid)
            union all select w.cand, w.nid, field, code, count(*) from way w join code k on k.tile_id = w.tile_id and k.nid <> w.nid group by all) group by all),
        after_n as (select cand, nid, n + shift as n from way join nsize using (nid)),
        s as ({_mi('after_c', 'after_n', 'cand, nid')})
        select tile_id, s.nid, {_round('score')} as score from s join (select cand, tile_id from way) using (cand) qualify row_number() over (partition by tile_id order by round(s.score, 12) desc, s.nid) = 1""",
    "expand_labels": f"with {_COARSE} select p.parcel_id, p.tile_id, case when mixed then lab.nid else p.nid end as nid from placed p join lab using (tile_id)",
    "edge_class": f"with {_CLASSED} select src, dst, edge_class, {_round('gap_ft')} as gap_ft from cls",
    "edge_class_pct": f"with {_CLASSED} select edge_class, count(*) as n, {_round('100.0 * count(*) / (select count(*) from cls)')} as percent, {_round('median(gap_ft)')} as median_gap, {_round('max(gap_ft)')} as max_gap from cls group by edge_class",
    "weak_tiles": f"with {_INNER}, e as (select src as tile_id, edge_class from inner_e union all select dst, edge_class from inner_e) select tile_id, sum((edge_class = 'rook')::int)::bigint as rook, count(*) as \"any\" from e group by tile_id having sum((edge_class = 'rook')::int) = 0",
    "fragments_by_class": f"with {_INNER}, rook as {_pieces('rook', chr(39) + 'rook' + chr(39))}, corner as {_pieces('rook+corner', chr(39) + 'rook' + chr(39) + ', ' + chr(39) + 'corner' + chr(39))} select * from rook union all select * from corner",
    "neighbors_of": f"with {_CLASSED} select dst as neighbour, edge_class from cls where src = 44 union all select src, edge_class from cls where dst = 44",
    "joint_edges": f"with {_INNER} select * from inner_e",
    "draw_segments": f"with {_CLASSED}, cross0 as (select src, dst, {_ends('x')}, {_ends('y')} from close where distance > 1e-9) select src, dst, 'node' as kind, {_round('(ax0 + ax1) / 2')} as x0, {_round('(ay0 + ay1) / 2')} as y0, {_round('(bx0 + bx1) / 2')} as x1, {_round('(by0 + by1) / 2')} as y1 from close union all select src, dst, 'crossing', {_round('px')}, {_round('py')}, {_round('qx')}, {_round('qy')} from cross0",
    "selection_report": f"with {_INNER} select tile_id, edge_class, count(*) as edges from (select src as tile_id, edge_class from inner_e union all select dst, edge_class from inner_e) group by all",
    "novelty_window": f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events, count(distinct user_id) as distinct_users, {_round('count(distinct user_id) / count(*)')} as novelty from events group by 1",
    "novelty_stream": f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events, count(distinct user_id) as distinct_users, {_round('count(distinct user_id) / count(*)')} as novelty from events group by 1",
    "novelty_sliding": f"select strftime(date_trunc('hour', ts) - back * interval 1 hour, '%Y-%m-%d %H:%M:%S') as start, count(*) as events, count(distinct user_id) as distinct_users, {_round('count(distinct user_id) / count(*)')} as novelty from events, range(0, 2) b(back) group by 1",
    "progress_ratio": f"with {_TRAILING} select iteration, events, distinct_parcels, {_round('distinct_parcels / events')} as ratio from trail",
    "change_fraction": f"with {_RELABELS}, last as (select parcel, max(iteration) as iteration from rel group by parcel) select count(*) as parcels, count(*) filter (where 100 - iteration < 20) as recent, {_round('count(*) filter (where 100 - iteration < 20) / count(*)')} as fraction from last",
    "stability_streak": f"""with {_TRAILING}, r as (select iteration as start, distinct_parcels / events as novelty from trail),
        b as (select *, sum((novelty >= 0.96)::int) over (order by start) as block from r), k as (select start, novelty, sum((novelty < 0.96)::int) over (partition by block order by start)::bigint as streak from b)
        select start, {_round('novelty')} as novelty, streak, streak >= 3 as settled from k""",
    "parallel_stats": f"with m as (select event_id % 4 as worker, event_id as iteration, event_id % 7 / 10.0 as temperature, event_id % 11 as accepted, event_id % 5 as rejected, event_id % 13 as boundary, event_id % 17 as num, event_id % 4 + 20 as den from events), l as (select * from m qualify row_number() over (partition by worker order by iteration desc) = 1) select max(iteration) as iteration, round(max(temperature)::double, 6) + 0.0 as temperature, sum(accepted)::bigint as accepted, sum(rejected)::bigint as rejected, sum(boundary)::bigint as boundary, {_round('sum(num) / sum(den)')} as score from l",
    "parse_place": f"""with {_STATES}, q as (select query, list_filter(list_transform(string_split(query, ','), lambda p : trim(p)), lambda p : p <> '') as parts, trim(query) as plain from {_values(_QUERIES, 'query')}),
        a as (select q.*, s.fips as comma_fips, regexp_extract(plain, '(?i)^(.*?) ({_alternatives(STATE_NAMES)})$', 2) as named, regexp_extract(plain, '(?i)^(.*?) ({_alternatives(STATE_NAMES)})$', 1) as head, string_split(plain, ' ') as w
              from q left join st s on len(parts) >= 2 and s.form = lower(parts[-1])),
        b as (select a.*, n.fips as name_fips, c.fips as code_fips from a left join st n on named <> '' and not n.short and n.form = lower(named) left join st c on len(w) >= 2 and c.short and c.form = lower(w[-1]))
        select query, case when comma_fips is not null then array_to_string(parts[:-2], ', ') when name_fips is not null then trim(head) when code_fips is not null then array_to_string(w[:-2], ' ') else plain end as name, coalesce(comma_fips, name_fips, code_fips) as fips from b""",
    "strip_suffix": f"select name, case when regexp_replace(trim(name), '(?i)(\\s+({_alternatives(AREA_SUFFIXES)}))+$', '') = '' then trim(name) else regexp_replace(trim(name), '(?i)(\\s+({_alternatives(AREA_SUFFIXES)}))+$', '') end as bare from {_values(_NAMES, 'name')}",
    "rank_places": f"select name, basename, state, area::double as area, case when lower(name) in ('lee county', 'lee') or lower(basename) in ('lee county', 'lee') or name in ('Lee CDP') then 0 else 1 end as tier from {_PLACES} where state = '12' and (lower(name) like 'lee%' or lower(basename) like 'lee%')",
    "slugify": f"select name, case when s = '' then 'run' else s end as slug from (select name, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') as s from {_values(['Fort Myers, FL', '  --  ', 'Éire 9', 'a__b', 'Lee County'], 'name')})",
    "cache_key_sha1": "select c_custkey, substr(sha1(c_name), 1, 16) as key from customer",
    "color_hash": "select c_custkey, cast(((c_custkey::hugeint * 2654435761 + 12345) // 8) % 20 as integer) as colour from customer",
    "quadsplit": f"select {_round('i * 0.1', 9)} as x0, {_round('j * 0.1', 9)} as y0, {_round('(i + 1) * 0.1', 9)} as x1, {_round('(j + 1) * 0.1', 9)} as y1 from (select unnest(generate_series(0, 3))::double as i) a, (select unnest(generate_series(0, 3))::double as j) b",
    "response_policy": f"select id, case when status = 200 and {_HINT} then 'split' when status = 200 then 'use' when status in (429, 503) then 'back_off' when status = 400 then 'split' else 'next_endpoint' end as action from {_RESPONSES}",
    "escape_quotes": "select name, replace(name, '''', '''''') as escaped from (values ('O''Brien'), ('plain'), ('''''')) n(name)",
    "candidate_years": "select unnest(generate_series(2020, 2027))::int as year",
    "json_elements": "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events",
    "checkpoint_prune": f"select run_id, iteration, is_final, not is_final and row_number() over (partition by run_id, is_final order by iteration desc) > 3 as \"drop\" from {_CHECKPOINTS}",
    "latest_checkpoint": f"select run_id, iteration, is_final from {_CHECKPOINTS} qualify row_number() over (partition by run_id order by iteration desc, is_final desc) = 1",
}
