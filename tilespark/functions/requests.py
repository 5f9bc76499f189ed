"""Request URLs, query parameters, admission and cache headers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions.once import bind

_INT = r"(-?\d+)"
# URL shapes by service family.
PREFIXED = r"^/(\w+)/(?:(1\.0\.0)/)?([^/]+)/(?:([^/]+)/)?" + f"{_INT}/{_INT}/{_INT}" + r"\.(\w+)"
RETINA = rf"/([^/]+)/{_INT}/{_INT}/{_INT}(?:@([^/]+)x)?\.(\w+)"
TERRAIN = rf"/([^/]+)/{_INT}/{_INT}/{_INT}\.(\w+)"
MATRIX = r"/wmts/([\w_.:-]+)/([\w_.:-]+)/(\d+)/(-?\d+)/(-?\d+)\.(\w+)"

FAMILY_PREFIXES: Mapping[str, str] = {
    "tiles": "xyz", "tms": "tms", "wmts": "wmts", "mapbox": "mapbox", "cesium": "cesium",
}
LAYER_NAME = r"^[a-zA-Z0-9_-]{1,256}$"


def url_family(path: Column, prefixes: Mapping[str, str] = FAMILY_PREFIXES) -> Column:
    head = F.regexp_extract(path, r"^/([^/]+)/", 1)
    table = F.create_map(*[F.lit(v) for pair in prefixes.items() for v in pair])
    return table[head]


def _text(path: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))


def parse_tile_url(path: Column, family: Column) -> Column:
    """Fields of a tile request path, with the reason it cannot be served (null when fine)."""
    shapes = {
        "xyz": dict(pattern=PREFIXED, version=2, layer=3, spec=4, z=5, x=6, y=7, fmt=8),
        "tms": dict(pattern=PREFIXED, version=2, layer=3, spec=4, z=5, x=6, y=7, fmt=8),
        "mapbox": dict(pattern=RETINA, layer=1, z=2, x=3, y=4, retina=5, fmt=6),
        "cesium": dict(pattern=TERRAIN, layer=1, z=2, x=3, y=4, fmt=5),
        "wmts": dict(pattern=MATRIX, layer=1, spec=2, z=3, x=4, y=5, fmt=6),
    }

    def pick(name: str, cast: str = "string") -> Column:
        out = F
        for fam, shape in shapes.items():
            if name in shape:
                out = out.when(family == fam, _text(path, shape["pattern"], shape[name]))
        return out.otherwise(F.lit(None)).try_cast(cast)

    matched = F
    for fam, shape in shapes.items():
        matched = matched.when(family == fam, path.rlike(shape["pattern"]))
    matched = matched.otherwise(F.lit(False))
    checked = family.isin("xyz", "tms")
    fields = F.struct(
        matched.alias("matched"), pick("version").alias("version"), pick("layer").alias("layer"), pick("spec").alias("layer_spec"),
        pick("z", "int").alias("z"), pick("x", "long").alias("x"), pick("y", "long").alias("y"),
        pick("retina", "int").alias("retina"), pick("fmt").alias("format"))

    def judged(f: Column) -> Column:
        reason = (
            F.when(~f.matched, "no match")
            .when(f.z.isNull() | f.x.isNull() | f.y.isNull(), "bad number")
            .when(checked & ((f.x < 0) | (f.y < 0) | (f.z < 0)), "negative coordinate")
            .when(checked & (f.z > 30), "zoom too deep")
        )
        names = ("version", "layer", "layer_spec", "z", "x", "y", "retina", "format")
        return F.struct(*[f[n].alias(n) for n in names], reason.alias("reason"))

    return bind(fields, judged)


def _decoded(text: Column) -> Column:
    escaped = text.contains("%") | text.contains("+")
    return F.when(escaped, F.try_url_decode(text)).otherwise(text)


def query_pairs(query: Column) -> Column:
    """``array<struct<k,v>>`` of a raw query string, keys upper-cased, both sides decoded."""
    items = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda s: s != "")
    sides = F.transform(items, lambda s: F.split(s, "=", 2))
    pairs = F.transform(sides, lambda a: F.struct(
        F.upper(_decoded(a[0])).alias("k"), _decoded(F.coalesce(F.get(a, F.lit(1)), F.lit(""))).alias("v")))
    return F.filter(pairs, lambda p: p.k.isNotNull() & p.v.isNotNull())


def _by_key(pairs: Column) -> Column:
    """``array<struct<key,value array>>`` in the order of keys, values in the order they were given, by one pass over sorted pairs."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p.k.alias("k"), i.alias("i"), p.v.alias("v"))))
    none = F.array().cast("array<struct<key:string,value:array<string>>>")

    def add(found: Column, p: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        more = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.struct(p.k.alias("key"), F.concat(last.value, F.array(p.v)).alias("value"))))
        return F.when((F.size(found) > 0) & (last.key == p.k), more).otherwise(F.concat(found, F.array(F.struct(p.k.alias("key"), F.array(p.v).alias("value")))))

    return F.aggregate(placed, none, add)


def query_params(query: Column) -> Column:
    """``map<string,array<string>>`` of a raw query string, keys in order."""
    return F.map_from_entries(_by_key(query_pairs(query)))


def canonical_query(params: Column, longest_name: int | None = None, longest_value: int | None = None) -> Column:
    """Normalised query string: valid names in order, values joined. With limits, longer names are left out and
    longer values cut; :func:`query_truncated` tells where."""
    size = "+" if longest_name is None else f"{{1,{longest_name}}}"
    valid = F.map_filter(params, lambda k, v: k.rlike(rf"^[\p{{L}}\p{{Nd}}_-]{size}$") & (F.size(v) > 0))

    def value(v: Column) -> Column:
        joined = F.array_join(v, ",")
        return joined if longest_value is None else F.substring(joined, 1, longest_value)

    def encoded(text: Column) -> Column:
        return bind(text, lambda t: F.when(t.rlike("^[A-Za-z0-9._*-]*$"), t).otherwise(F.url_encode(t)))  # most need no encoding

    entries = F.transform(F.sort_array(F.map_entries(valid)), lambda e: F.concat_ws("=", encoded(e.key), encoded(value(e.value))))
    return F.array_join(entries, "&")


def query_truncated(params: Column, longest_name: int, longest_value: int) -> Column:
    """Whether these limits leave something out of :func:`canonical_query`."""
    return F.exists(F.map_entries(params), lambda e: (F.length(e.key) > longest_name) | (F.length(F.array_join(e.value, ",")) > longest_value))


def param(params: Column, name: str) -> Column:
    return F.element_at(params[name.upper()], 1)


def _numbers(params: Column, name: str, kind: str) -> Column:
    """Numbers given as separate values or one comma list; unreadable ones are null."""
    values = params[name.upper()]
    items = F.when(F.size(values) == 1, F.split(values[0], ",")).otherwise(values)
    return F.transform(items, lambda v: v.try_cast(kind))


def _complete(numbers: Column, count: int) -> Column:
    return F.coalesce((F.size(numbers) == count) & ~F.exists(numbers, lambda v: v.isNull()), F.lit(False))


def param_bbox(params: Column) -> Column:
    """Box of a request; anything unreadable is the all-zero box."""
    names = ("minx", "miny", "maxx", "maxy")
    return bind(_numbers(params, "bbox", "double"), lambda n: F.when(
        _complete(n, 4), F.struct(*[n[i].alias(name) for i, name in enumerate(names)])
    ).otherwise(F.struct(*[F.lit(0.0).alias(name) for name in names])))


def param_size(params: Column) -> Column:
    """WIDTH and HEIGHT, or one SIZE; zero unless both parse."""
    sides = F.array(*[param(params, n).try_cast("long") for n in ("width", "height")])
    given = F.when(_complete(sides, 2), sides).otherwise(_numbers(params, "size", "long"))
    return bind(given, lambda n: F.struct(*[
        F.when(_complete(n, 2), n[i]).otherwise(F.lit(0).cast("long")).alias(name) for i, name in enumerate(("width", "height"))]))


def param_tile(params: Column) -> Column:
    """TILECOL, TILEROW and TILEMATRIX; one unreadable value voids all three."""
    raw = F.array(*[F.coalesce(param(params, n), F.lit("-1")).try_cast("long") for n in ("tilecol", "tilerow", "tilematrix")])
    return bind(raw, lambda n: F.struct(*[
        F.when(_complete(n, 3), n[i]).otherwise(F.lit(-1).cast("long")).alias(name) for i, name in enumerate("xyz")]))


def valid_layer_name(name: Column) -> Column:
    return F.coalesce(name.rlike(LAYER_NAME), F.lit(False))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(pattern)
    return hit


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def admission_reason(
    url: Column, deny_patterns: Sequence[str], allow_patterns: Sequence[str],
    domain_denied: Column, domain_allowed: Column,
) -> Column:
    """First rule that refuses a URL, null when it may be fetched."""
    out = F.when(F.coalesce(url, F.lit("")) == "", "missing url")
    if deny_patterns:
        out = out.when(any_match(url, deny_patterns), "forbidden url")
    if allow_patterns:
        out = out.when(~any_match(url, allow_patterns), "no filter matches")
    return out.when(domain_denied | ~domain_allowed, "forbidden domain")


def content_path(url: Column) -> Column:
    digest = F.sha1(url)
    return F.concat_ws("/", F.substring(digest, 1, 2), digest)


def etag(timestamp_text: Column, size: Column) -> Column:
    return F.upper(F.sha2(F.concat(timestamp_text, size.cast("string")), 512))


def cache_control(cacheable: Column, max_age: int) -> Column:
    public = F.lit(None if max_age == -1 else f"public, max-age={max_age}, s-maxage={max_age}").cast("string")
    return F.when(cacheable, public).otherwise("no-cache, no-store")


def response_status(tag: Column, mtime: Column, if_none_match: Column, if_modified_since: Column) -> Column:
    """304 when the client's copy is current, else 200."""
    same = F.coalesce((if_none_match != "") & (if_none_match == tag), F.lit(False))
    unchanged = F.coalesce(mtime < if_modified_since, F.lit(False))
    return F.when(same | unchanged, 304).otherwise(200)
