"""The operators' queries in DuckDB's SQL, where it can express them: written from the definitions of the results, not from the code.

Where an operator is a method to find what is defined without it (near duplicates, repeated lines, windows, spans), the SQL
looks at all candidates, which is affordable on small tables alone.
"""

from __future__ import annotations

from .line_dedup import WORD as LINE_WORD
from .rollup import WORD
from .secrets import BASE, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '{WORD}')"


def _hash(text: str) -> str:
    """60 bits of the MD5."""
    return f"cast('0x' || substring(md5({text}), 1, 15) as bigint)"


# --- CRC-32, a nibble at a time over pieces of 256 bytes; pieces are joined by the operator of 256 zero bytes


def _nibble_table() -> list[int]:
    out = []
    for v in range(16):
        for _ in range(4):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


_TABLE = _nibble_table()


def _step(value: int, nibbles: int) -> int:
    for _ in range(nibbles):
        value = (value >> 4) ^ _TABLE[value & 15]
    return value


_JOIN = " ".join(f"xor({[_step(v << (4 * k), 512) for v in range(16)]}[1 + ((a >> {4 * k}) & 15)]," for k in range(8)) + " x" + ")" * 8
#: Four bytes that bring an empty register to all ones, as CRC-32 begins.
_BEGIN = next(bytes(b).hex().upper() for b in [(0x62, 0xF5, 0x26, 0x92)] if _step(int.from_bytes(b, "little"), 8) == 0xFFFFFFFF)


def crc_tables(name: str, source: str, key: str, blob: str) -> str:
    """Common table expressions; ``name`` has the column crc for each ``key`` of ``source``."""
    return f"""{name}_h as (select {key}, '{_BEGIN}' || hex({blob}) h from {source}),
{name}_p as (select {key}, repeat('0', (512 - length(h) % 512) % 512) || h h from {name}_h),
{name}_c as (select {key}, c, substring(h, 512 * c + 1, 512) h from (select {key}, h, unnest(range(0, length(h) // 512)) c from {name}_p)),
{name}_n as (select {key}, c, list_transform(range(0, 512), lambda k: cast(instr('0123456789ABCDEF', h[k + 2 - 2 * (k % 2)]) - 1 as bigint)) l from {name}_c),
{name}_r as (select {key}, c, list_reduce(l, lambda a, x: xor(a >> 4, {_TABLE}[1 + (xor(a, x) & 15)]), 0::bigint) r from {name}_n),
{name} as (select {key}, xor(list_reduce(list(r order by c), lambda a, x: {_JOIN}, 0::bigint), 4294967295) crc from {name}_r group by {key})"""


# --- 2


def _cased(pattern: str) -> str:
    """Both cases of every letter outside a class, for patterns that begin with (?i)."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, inside, k, p = "", False, 0, pattern[4:]
    while k < len(p):
        if p[k] == "\\":
            n = 4 if p[k + 1] == "x" else 2
            out, k = out + p[k : k + n], k + n
            continue
        inside = (inside or p[k] == "[") and p[k] != "]"
        out += f"[{p[k].upper()}{p[k]}]" if p[k].isalpha() and not inside else p[k]
        k += 1
    return out


def _op2() -> str:
    parts = []
    for k, r in enumerate(RULES):
        head = _cased(r.pattern).replace("(", "(?:").replace("'", "''")
        pattern = f"{head}({r.tail}+)" if r.tail else f"({head})"
        parts.append(f"select doc_id, {k} k, '{r.kind}' kind, {r.least} least, regexp_extract_all(t, '{pattern}', 0) a, regexp_extract_all(t, '{pattern}', 1) v, string_split_regex(t, '{pattern.replace('(' + r.tail, '(?:' + r.tail) if r.tail else '(?:' + pattern[1:]}') b from t")
    base = ", ".join(f"'{b}'" for b in BASE)
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k){where}, '')"
    return f"""with t as (select doc_id, {_TEXT} t from documents), m as ({" union all ".join(parts)}),
x as (select doc_id, k, kind, least, v[i] v, list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda y: length(y))), 0) s, length(a[i]) n from (select *, unnest(range(1, len(a) + 1)) i from m)),
y as (select doc_id, k, kind, cast(s as bigint) s, cast(s + n as bigint) e from x where length(v) >= least)
select t.doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
sha256({joined(f" filter (kind in ({base}))")}) base_sha256, {joined("")} spans from t left join y using (doc_id) group by t.doc_id"""


# --- 4

_OP4 = f"""with d as (select doc_id, {_words(_TEXT)} w from documents), b as (select item_id, {_words(_TEXT)} w from benchmark),
g as (select distinct item_id, len(x) n, array_to_string(x, ' ') g from (select item_id, w[i:i + 7] x from (select item_id, w, unnest(range(1, greatest(2, len(w) - 6))) i from b where len(w) > 0))),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) i from d),
h as (select doc_id, i, g.n, item_id from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') x from p, (select distinct n from g) where i + n - 1 <= len(w)) q join g on g.g = q.x and g.n = q.n),
c as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from (select distinct doc_id, i, n from h)) group by doc_id),
s as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, cast(item_id as varchar) item_id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join c using (doc_id) left join s using (doc_id)"""

# --- 5: all pairs of documents that share a shingle

_OP5 = f"""with recursive d as (select doc_id, {_words(_TEXT)} w from documents),
bag as (select doc_id, g, count(*) c from (select doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i from d where len(w) > 0)) group by 1, 2),
size as (select doc_id, sum(c) n from bag group by 1),
pairs as (select a.doc_id a, b.doc_id b, sum(least(a.c, b.c)) o from bag a join bag b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pairs join size x on x.doc_id = a join size y on y.doc_id = b where o >= 0.8 * (x.n + y.n - o) - 1e-9),
ends as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from ends union select r.a, l.b from reach r join ends l on r.b = l.a),
root as (select a, least(a, min(b)) r from reach group by a)
select doc_id, coalesce(r, doc_id) class_id, coalesce(r, doc_id) = doc_id kept from documents left join root on a = doc_id"""

# --- 7: what is stored, without the decoded signal

_LITTLE = "substring(printf('%08X', {0}), 7, 2) || substring(printf('%08X', {0}), 5, 2) || substring(printf('%08X', {0}), 3, 2) || substring(printf('%08X', {0}), 1, 2)"


def _op7() -> str:
    little = lambda x: _LITTLE.format(x)
    ascii_ = lambda x: f"hex(encode('{x}'))"
    plain = lambda tag: f"'{tag:02X}000100401F0000401F0000010008000000'"
    return f"""with t as (select doc_id, hex(encode({_TEXT})) h from documents),
p as (select doc_id, octet_length(unhex(h)) n_bytes, unhex(h || repeat('00', case when h = '' then 64 else (64 - (length(h) // 2) % 64) % 64 end)) b from t),
{crc_tables("crcs", "p", "doc_id", "b")},
{crc_tables("tails", "(select doc_id, unhex(right(hex(b), 128)) z from p)", "doc_id", "z")},
f as (select doc_id, n_bytes, hex(b) b, octet_length(b) n, crcs.crc % 3 codec, tails.crc tail from p join crcs using (doc_id) join tails using (doc_id)),
m as (select *, case codec when 0 then {plain(7)} when 1 then {plain(6)} else '11000100401F00008710000040000400' || '02007900' end form, case when codec = 2 then n // 64 * 121 else n end samples from f),
w as (select *, {ascii_("WAVE")} || {ascii_("fmt ")} || {little("length(form) // 2")} || form || {ascii_("fact")} || '04000000' || {little("samples")} || {ascii_("data")} || {little("n")} || b body from m),
v as (select *, {ascii_("RIFF")} || {little("length(body) // 2")} || body media from w)
select doc_id, n_bytes, n payload_bytes, sha256(unhex(b)) payload_sha256, tail tail_crc32, cast(length(media) // 2 as bigint) media_bytes, sha256(unhex(media)) media_sha256 from v"""


# --- 8: runs of lines that stand earlier too

_OP8 = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
n as (select *, len(regexp_extract_all(line, '{LINE_WORD}')) nw from l),
u as (select doc_id, pos, line, nw, row_number() over (partition by doc_id order by pos) r, sum(nw) over (partition by doc_id order by pos) e from n where nw > 0),
z as (select a.doc_id, a.r, min(b.r) last from u a join u b on a.doc_id = b.doc_id and b.r >= a.r and b.e - a.e + a.nw >= 50 group by 1, 2
union select a.doc_id, max(b.r), a.r from u a join u b on a.doc_id = b.doc_id and b.r <= a.r and a.e - b.e + b.nw >= 50 group by a.doc_id, a.r),
k as (select z.doc_id, z.r, z.last, string_agg(u.line, chr(10) order by u.r) run from z join u on u.doc_id = z.doc_id and u.r between z.r and z.last group by 1, 2, 3),
f as (select *, row_number() over (partition by run order by doc_id, r) turn from k),
dead as (select distinct u.doc_id, u.pos from f join u on u.doc_id = f.doc_id and u.r between f.r and f.last where turn > 1),
g as (select n.doc_id, count(*) n_lines, count(dead.pos) n_removed, string_agg(line, chr(10) order by n.pos) filter (dead.pos is null) text from n left join dead using (doc_id, pos) group by 1)
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, case when documents.text is null then null else coalesce(g.text, '') end as text from documents left join g using (doc_id)"""

# --- 9

_WORDS = f"""select source, lang, 'words' tokenizer, count(*) n_docs, cast(sum(len(regexp_extract_all({_TEXT}, '{WORD}'))) as bigint) n_tokens, cast(sum(length({_TEXT})) as bigint) n_chars
from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null) group by source, lang"""


# --- 10


def _draw(key: str, level: str, parent: str, name: str, weight: str) -> str:
    return f"-ln((cast({_hash(f"{key} || '|{level}|' || {parent} || '|' || {name}")} as double) + 0.5) / 1152921504606846976.0) / {weight}"


def _op10() -> str:
    shards = ", ".join(f"({i}, 'region{i % 4}', 'rack{i // 4 % 5}')" for i in range(40))

    def descend(name: str, leaves: str) -> str:
        best = lambda level, parent, child, weight, source, out: f"select doc_id, arg_min({child}, draw) {out} from (select distinct doc_id, {child}, {_draw('k', level, parent, child, weight)} draw from {source}) group by doc_id"
        return f"""{name}_l as ({leaves}),
{name}_1 as ({best("region", "''", "region", "w", f"d, (select region, count(*) w from {name}_l group by 1)", "region")}),
{name}_2 as ({best("rack", "region", "rack", "w", f"d join {name}_1 using (doc_id) join (select region, rack, count(*) w from {name}_l group by 1, 2) using (region)", "rack")}),
{name} as ({best("shard", "region || '/' || rack", "cast(shard as varchar)", "1.0", f"d join {name}_1 using (doc_id) join {name}_2 using (doc_id) join {name}_l using (region, rack)", "shard").replace("distinct doc_id, cast(shard as varchar),", "distinct doc_id, cast(shard as integer) shard,").replace("arg_min(cast(shard as varchar), draw)", "arg_min(shard, draw)")})"""

    leaves = f"select * from (values {shards}) s(shard, region, rack)"
    return f"""with d as (select doc_id, coalesce(cast(doc_id as varchar), 'null key') k, {_TEXT} t, {_hash(_TEXT)} group_id from documents),
{descend("own", leaves)}, {descend("grown", leaves + " union all select 40, 'region+40', 'rack0'")},
{crc_tables("crcs", "d", "doc_id", "encode(t)")},
x as (select d.*, own.shard, grown.shard grown_shard, crc, {_hash("k || '|' || cast(group_id as varchar)")} % 64 bucket from d join own using (doc_id) join grown using (doc_id) join crcs using (doc_id))
select doc_id, cast(octet_length(encode(t)) + 16 as bigint) size, crc text_crc32, 'key' law, shard, row_number() over (partition by shard order by bucket, doc_id, crc, group_id) - 1 slot, grown_shard, group_id from x"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": _op2(),
        "op4_decontamination": _OP4,
        "op5_near_dedup": _OP5,
        "media_stored": _op7(),
        "op8_line_dedup": _OP8,
        "rollup_words": _WORDS,
        "op10_sharding": _op10(),
    }
