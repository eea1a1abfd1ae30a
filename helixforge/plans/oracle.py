"""What each query must return, in SQL over the same tables, written without the operators' code."""

from __future__ import annotations

from helixforge.operators.forest import Node

K, MAPS, LIMIT, READ, SPAN = 20, 4, 10, 100, 1048576


def _chain(*parts: str) -> str:
    """Named tables, each once, in order."""
    seen: dict[str, str] = {}
    for p in parts:
        for name, body in TABLES[p] if isinstance(TABLES[p], list) else [(p, TABLES[p])]:
            seen.setdefault(name, body)
    return "with " + ",\n".join(f"{n} as materialized ({b})" for n, b in seen.items()) + "\n"


def _needs(name: str, done: list[str] | None = None) -> list[str]:
    done = [] if done is None else done
    for other in AFTER.get(name, []):
        _needs(other, done)
    if name not in done:
        done.append(name)
    return done


def over(name: str, select: str) -> str:
    return _chain(*_needs(name)) + select


def _refined(name: str, select: str) -> str:
    """As over, with five passes between the rows and what is made of them: each drops the candidates that cover the first
    significant column of their anchor with another letter than the anchor's."""
    passes = []
    for i in range(5):
        passes += [
            (f"seen{i}", f"""select anchor_id, col, base, count(*) as n, sum(count(*)) over (partition by anchor_id, col) as coverage
                from (select anchor_id, shift + i - 1 as col, sequence[i] as base from (select *, unnest(range(1, {READ + 1})) as i from rows{i})) where col between 0 and {READ - 1} group by anchor_id, col, base"""),
            (f"first{i}", f"""select anchor_id, min(col) as at from (select anchor_id, col from seen{i} where n >= 2 and n / coverage >= 0.3::double
                group by anchor_id, col having count(*) >= 2) group by anchor_id"""),
            (f"rows{i + 1}", f"""select r.* from rows{i} r join (select anchor_id, sequence as own from rows{i} where cand_id is null) using (anchor_id) left join first{i} f using (anchor_id)
                where r.cand_id is null or f.at is null or f.at < r.shift or f.at >= r.shift + {READ} or r.sequence[f.at - r.shift + 1] = own[f.at + 1]"""),
        ]
    out = []
    for part in _needs(name):
        named = TABLES[part] if isinstance(TABLES[part], list) else [(part, TABLES[part])]
        out += [("rows0", named[0][1]), *passes, ("rows", "select * from rows5")] if part == "rows" else named
    return "with " + ",\n".join(f"{n} as materialized ({b})" for n, b in out) + "\n" + select


def _code(s: str, k: int) -> str:
    return " + ".join(f"(instr('ACGT', substr({s}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}::bigint" for i in range(k))


def _murmur_step(x: str, c: int) -> str:
    """x * c modulo 2^64 from halves of 32 bits, none of whose products overflow."""
    m, low, high = "4294967295::ubigint", f"({c & 0xFFFFFFFF}::ubigint)", f"({c >> 32}::ubigint)"
    xl, xh = f"({x} & {m})", f"({x} >> 32)"
    upper = f"(((({xl} * {low}) >> 32) + (({xl} * {high}) & {m}) + (({xh} * {low}) & {m})) & {m})"
    return f"({upper} * 4294967296::ubigint + (({xl} * {low}) & {m}))"


def _murmur(columns: dict[str, str], source: str, keep: str) -> list[tuple[str, str]]:
    """Tables m0 to m4, each one step of the finalizer for all columns."""
    names = list(columns)
    each = lambda f: ", ".join(f"{f(n)} as {n}" for n in names)
    x33 = lambda n: f"xor({n}, {n} >> 33)"
    return [
        ("m0", f"select {keep}, " + ", ".join(f"cast({v} as ubigint) as {n}" for n, v in columns.items()) + f" from {source}"),
        ("m1", f"select {keep}, {each(x33)} from m0"),
        ("m2", f"select {keep}, {each(lambda n: _murmur_step(n, 0xFF51AFD7ED558CCD))} from m1"),
        ("m3", f"select {keep}, {each(x33)} from m2"),
        ("m4", f"select {keep}, {each(lambda n: _murmur_step(n, 0xC4CEB9FE1A85EC53))} from m3"),
        ("m5", f"select {keep}, {each(x33)} from m4"),
    ]


_LETTERS = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_MASK = (1 << 2 * K) - 1
_BASES = "ACGT"
_SIGNED = "cast(case when {0} >= 9223372036854775808 then cast({0} as hugeint) - 18446744073709551616 else cast({0} as hugeint) end as bigint)"

TABLES: dict[str, str | list[tuple[str, str]]] = {
    "dna": f"select doc_id, {_LETTERS} as s from documents",
    "perfect": f"""select doc_id * {SPAN} + w as read_id, (doc_id * {SPAN} + w) // 2 as pair_id, cast(w % 2 as integer) as mate, substr(s, least(w * {READ}, length(s) - {READ}) + 1, {READ}) as sequence
        from (select doc_id, s, unnest(range(0, (length(s) + {READ - 1}) // {READ})) as w from dna where length(s) >= {READ})""",
    "original": f"""select read_id,
            list_aggregate(list_transform(range(1, {READ + 1}), lambda i: case when (read_id * 31 + i * 17) % 97 = 0 then translate(sequence[i], 'ACGT', 'CGTA') else sequence[i] end), 'string_agg', '') as sequence,
            list_aggregate(list_transform(range(1, {READ + 1}), lambda i: chr(cast((read_id + i) % 41 + 33 as integer))), 'string_agg', '') as quality
        from perfect""",
    "ambiguous": f"select read_id, pair_id, mate, case when read_id % 7 = 0 then left(sequence, read_id % {READ}) || 'N' || substr(sequence, read_id % {READ} + 2) else sequence end as sequence from perfect",
    "places": f"select read_id, i as pos, substr(sequence, i, {K}) as kmer from (select read_id, sequence, unnest(range(1, {READ - K + 2})) as i from original)",
    "kmers": f"select read_id, pos, {_code('c', K)} as code from (select read_id, pos, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as c from places)",
    "true_places": f"select read_id, i as pos, substr(sequence, i, {K}) as kmer from (select read_id, sequence, unnest(range(1, {READ - K + 2})) as i from perfect)",
    "true_kmers": f"select read_id, pos, {_code('c', K)} as code from (select read_id, pos, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as c from true_places)",
    "hashed": _murmur({f"h{i}": f"code + {i}" for i in range(MAPS)}, "kmers", "read_id, pos"),
    "sketches": "select read_id, " + ", ".join(f"min(h{i}) & {_MASK}::ubigint as h{i}" for i in range(MAPS)) + " from m5 group by read_id",
    "keys": " union all ".join(f"select read_id, {i} as map_id, cast(h{i} as bigint) as key from sketches" for i in range(MAPS)),
    "sizes": "select map_id, key, count(*) as n from keys group by map_id, key",
    "pruned": f"select keys.* from keys join sizes using (map_id, key) where n between 2 and {LIMIT}",
    "pairs": "select distinct a.read_id as anchor_id, b.read_id as cand_id from pruned a join pruned b using (map_id, key) where a.read_id <> b.read_id",
    "strands": """select anchor_id, cand_id, a.sequence as a, c.sequence as f, reverse(translate(c.sequence, 'ACGT', 'TGCA')) as r
        from pairs join original a on a.read_id = anchor_id join original c on c.read_id = cand_id""",
    "tries": f"""select anchor_id, cand_id, s, {READ} - abs(s) as overlap,
            hamming(substr(a, greatest(s, 0) + 1, {READ} - abs(s)), substr(f, greatest(-s, 0) + 1, {READ} - abs(s))) as fo,
            hamming(substr(a, greatest(s, 0) + 1, {READ} - abs(s)), substr(r, greatest(-s, 0) + 1, {READ} - abs(s))) as ro
        from (select *, unnest(range(-70, 71)) as s from strands)""",
    "bests": """select anchor_id, cand_id, min((fo + 2 * abs(s)) * 1000000 + abs(s) * 1000 + s + 500) as f, min((ro + 2 * abs(s)) * 1000000 + abs(s) * 1000 + s + 500) as r
        from tries group by anchor_id, cand_id""",
    "shifts": "select anchor_id, cand_id, cast(f % 1000 - 500 as integer) as fs, cast(r % 1000 - 500 as integer) as rs, f // 1000000 as fc, r // 1000000 as rc from bests",
    "counted": f"""select anchor_id, cand_id, fs as f_shift, cast({READ} - abs(fs) as integer) as f_overlap, cast(fc - 2 * abs(fs) as integer) as f_ops,
            rs as r_shift, cast({READ} - abs(rs) as integer) as r_overlap, cast(rc - 2 * abs(rs) as integer) as r_ops from shifts""",
    "aligned": """select anchor_id, cand_id, f_shift, f_overlap, f_ops, f_ops <= 0.2::double * f_overlap as f_valid,
            r_shift, r_overlap, r_ops, r_ops <= 0.2::double * r_overlap as r_valid from counted""",
    "rates": """select *, case when f_valid and f_overlap >= 30 then f_ops / f_overlap end as f, case when r_valid and r_overlap >= 30 then r_ops / r_overlap end as r from aligned""",
    "sided": """select *, case
            when f is null and r is null then 3
            when r is null or f < r then case when f < 0.2::double then 1 else 3 end
            when f is null or r < f then case when r < 0.2::double then 2 else 3 end
            when f < 0.2::double then case when f_overlap > r_overlap then 1 else 2 end else 3 end as orientation,
            case
            when f is null and r is null then 3
            when r is null or f < r then case when f < 0.06::double * 4 then 1 else 3 end
            when f is null or r < f then case when r < 0.06::double * 4 then 2 else 3 end
            when f < 0.06::double * 4 then case when f_overlap > r_overlap then 1 else 2 end else 3 end as by_estimate
        from rates""",
    "good": """select anchor_id, cand_id, orientation, shift, overlap, n_ops, cast(floor((1 - sqrt(n_ops / (overlap * 0.2::double))) * 1000000 + 0.5) as bigint) as weight
        from (select anchor_id, cand_id, orientation, case orientation when 1 then f_shift else r_shift end as shift,
            case orientation when 1 then f_overlap else r_overlap end as overlap, case orientation when 1 then f_ops else r_ops end as n_ops
            from sided where orientation < 3)""",
    "rows": """select anchor_id, cand_id, orientation, shift, weight, case orientation when 1 then sequence else reverse(translate(sequence, 'ACGT', 'TGCA')) end as sequence,
            case orientation when 1 then quality else reverse(quality) end as quality
        from good join original on read_id = cand_id
        union all select anchor_id, null, 1, 0, 1000000, sequence, quality from (select distinct anchor_id from good) join original on read_id = anchor_id""",
    "letters": f"""select anchor_id, cand_id, shift + i - 1 as col, sequence[i] as base, weight as w,
            cast(floor(weight * greatest(0.001::double, 1 - pow(10::double, -(ascii(quality[i]) - 33) / 10.0::double)) + 0.5) as bigint) as wq
        from (select *, unnest(range(1, {READ + 1})) as i from rows)""",
    "summed": "select anchor_id, col, "
    + ", ".join(f"cast(count(*) filter (where base = '{b}') as integer) as n_{b.lower()}" for b in _BASES)
    + ", "
    + ", ".join(f"cast(coalesce(sum(w) filter (where base = '{b}'), 0) as bigint) as w_{b.lower()}" for b in _BASES)
    + ", "
    + ", ".join(f"cast(coalesce(sum(wq) filter (where base = '{b}'), 0) as bigint) as q_{b.lower()}" for b in _BASES)
    + ", cast(count(*) as integer) as coverage, max(base) filter (where cand_id is null) as anchor_base from letters group by anchor_id, col",
    "columns": """select *, greatest(w_a, w_c, w_g, w_t) as top, w_a + w_c + w_g + w_t as total,
            case greatest(w_a, w_c, w_g, w_t) when w_a then 'A' when w_c then 'C' when w_g then 'G' else 'T' end as consensus,
            case greatest(q_a, q_c, q_g, q_t) when q_a then 'A' when q_c then 'C' when q_g then 'G' else 'T' end as q_consensus
        from summed""",
    "supported": """select *, case when total > 0 then top / total else 0 end as support,
            case anchor_base when 'A' then w_a when 'C' then w_c when 'G' then w_g when 'T' then w_t end as orig_weight,
            case anchor_base when 'A' then n_a when 'C' then n_c when 'G' then n_g when 'T' then n_t end as orig_coverage from columns""",
    "props": """select anchor_id, round(avg(support), 6) as avg_support, round(min(support), 6) as min_support, min(coverage) as min_coverage, max(coverage) as max_coverage
        from supported where anchor_base is not null group by anchor_id""",
    # coverage 3 and error rate 0.06: simple 0.94, 0.82, 1.8; high quality 0.97, 0.91
    "judged": """select *, avg_support <= 0.94 - 1e-5 as failed_avg, min_support <= 0.82 - 1e-5 as failed_min, min_coverage < 1.8 as failed_coverage,
            avg_support > 0.97 - 1e-5 and min_support > 0.91 - 1e-5 and min_coverage > 1.8 as is_hq from props""",
    "shares": "select anchor_id, col, letter, n, n / coverage as ratio from (select anchor_id, col, coverage, unnest(['A', 'C', 'G', 'T']) as letter, unnest([n_a, n_c, n_g, n_t]) as n from columns where anchor_base is not null)",
    "many": "select anchor_id, col, letter, ratio from (select *, count(*) over (partition by anchor_id, col) as c from shares where n >= 2 and ratio >= 0.3::double) where c >= 2",
    "near": "select anchor_id, col, anchor_base, consensus, coverage, min(support) over (partition by anchor_id order by col range between 5 preceding and 5 following) as near from supported where anchor_base is not null",
    "anchors": """select anchor_id as read_id, is_hq,
            string_agg(case when is_hq or (near > 0.82 - 1e-5 and coverage >= 3) then consensus else anchor_base end, '' order by col) as sequence
        from near join judged using (anchor_id) group by anchor_id, is_hq""",
    "others": f"""select cand_id as read_id, anchor_id, case orientation when 1 then s else reverse(translate(s, 'ACGT', 'TGCA')) end as sequence
        from (select r.anchor_id, r.cand_id, r.orientation, string_agg(c.consensus, '' order by c.col) as s
            from rows r join judged j on r.anchor_id = j.anchor_id and j.is_hq
            join columns c on c.anchor_id = r.anchor_id and c.col >= r.shift and c.col < r.shift + {READ}
            where r.cand_id is not null and r.shift >= -15 and r.shift <= 15
            group by r.anchor_id, r.cand_id, r.orientation)""",
    "votes": "select read_id, count(*) as n, bool_and(others.sequence = anchors.sequence) as agree from others join anchors using (read_id) group by read_id",
    "corrected": """select read_id, case when a.sequence is not null and (is_hq or coalesce(agree, true)) then a.sequence else o.sequence end as sequence,
            case when is_hq then 3 when a.sequence is null or not coalesce(agree, true) then 0 when coalesce(n, 0) > 0 then 2 when a.sequence <> o.sequence then 1 else 0 end as q
        from original o left join anchors a using (read_id) left join votes using (read_id)""",
    "judgements": f"""select name, read_id, count(*) filter (where o <> p and c = p) as tp, count(*) filter (where o = p and c <> p) as fp,
            count(*) filter (where o <> p and c <> p) as fn, count(*) filter (where o = p and c = p) as tn
        from (select name, read_id, o[i] as o, p[i] as p, c[i] as c from (
            select x.name, o.read_id, o.sequence as o, p.sequence as p, x.sequence as c, unnest(range(1, {READ + 1})) as i
            from original o join perfect p using (read_id) join (
                select 'corrected' as name, read_id, sequence from corrected union all select 'original', read_id, sequence from original) x using (read_id)))
        group by name, read_id""",
    "confusion": "select name, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn from judgements group by name",
    "hist": "select name, n_errors, n_reads, cast(sum(n_reads) over (partition by name order by n_errors) as bigint) as cumulative from (select name, fp + fn as n_errors, count(*) as n_reads from judgements group by all)",
    "differing": f"""select a.read_id, a.sequence as now, list_filter(range(1, {READ + 1}), lambda i: a.sequence[i] <> o.sequence[i]) as places from anchors a join original o using (read_id)""",
    "lines": """select l_returnflag as ext, cast(l_linenumber as integer) as anchor_threshold, cast(trunc(l_quantity) as integer) as candidate_threshold,
            cast(l_suppkey % 3 as varchar) as sample, l_partkey % 1009 as tp, l_suppkey % 97 as fp, l_orderkey % 31 as fn, l_partkey % 13 as tn,
            row_number() over (partition by ext, anchor_threshold, candidate_threshold, sample order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as i,
            count(*) over (partition by ext, anchor_threshold, candidate_threshold, sample) as n_seen
        from lineitem""",
    "single": "select ext, anchor_threshold, candidate_threshold, sample, tp, fp, fn, tn, n_seen from lines where i = 1",
    "totals": "select ext, anchor_threshold, candidate_threshold, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp from single group by all",
}

AFTER = {
    "perfect": ["dna"], "original": ["perfect"], "ambiguous": ["perfect"], "places": ["original"], "kmers": ["places"], "true_places": ["perfect"],
    "true_kmers": ["true_places"], "hashed": ["kmers"], "sketches": ["hashed"], "keys": ["sketches"], "sizes": ["keys"], "pruned": ["sizes"],
    "pairs": ["pruned"], "strands": ["pairs"], "tries": ["strands"], "bests": ["tries"], "shifts": ["bests"], "counted": ["shifts"],
    "aligned": ["counted"], "rates": ["aligned"], "sided": ["rates"], "good": ["sided"], "rows": ["good"], "letters": ["rows"],
    "summed": ["letters"], "columns": ["summed"], "supported": ["columns"], "props": ["supported"], "judged": ["props"], "shares": ["columns"],
    "many": ["shares"], "near": ["supported"], "anchors": ["near", "judged"], "others": ["columns", "judged"], "votes": ["others", "anchors"],
    "corrected": ["anchors", "votes"], "judgements": ["corrected"], "confusion": ["judgements"], "hist": ["judgements"],
    "differing": ["anchors"], "single": ["lines"], "totals": ["single"],
}


def _walk(side: Node | float, feature: str) -> str:
    if not isinstance(side, Node):
        return f"{side}::double"
    return f"case when {feature.format(side.attribute + 1)} <= {side.split!r}::double then {_walk(side.left, feature)} else {_walk(side.right, feature)} end"


def _forest(most: int = 16) -> str:
    from helixforge.plans.queries import TREES

    return "(" + " + ".join(_walk(t, "cast(embedding[{}] as double)") for t in TREES[:most]) + f") / {len(TREES[:most])}"


def _ratio(a: str, b: str) -> str:
    return f"round(case when {b} = 0 then 0::double else ({a}) / ({b}) end, 6)"


_SPLIT_WEIGHT = "round(1 - sqrt(f_ops / (f_overlap * 0.2::double)), 6) as w, round((f_overlap / 100) * ((f_overlap / 100) + (f_overlap - f_ops) * 0.2::double) / (1 + f_overlap * 0.2::double), 6) as by_length"


def oracles() -> dict[str, str]:
    frontier = """, line as (select t.*, not exists (
            select 1 from totals o where {same} and ((o.tp > t.tp and o.fp <= t.fp) or (o.tp = t.tp and o.fp < t.fp))) as best from totals t)
        select ext, anchor_threshold, candidate_threshold, tp, fp from line where best"""
    return {
        "read_stats": over("perfect", "select coalesce(min(length(sequence)), 2147483647) as min_length, coalesce(max(length(sequence)), 0) as max_length, count(*) as n_reads from perfect"),
        "read_length_hist": over("dna", "select length(s) as len, count(*) as n_reads from dna group by 1"),
        "fastq_files": over("original", "select row_number() over (order by read_id) - 1 as read_id, 'read ' || read_id as header, sequence, quality from original"),
        "gzip_files": over("original", "select row_number() over (order by read_id) - 1 as read_id, 'read ' || read_id as header, sequence, quality from original"),
        "fasta_files": over("perfect", "select row_number() over (order by read_id) - 1 as read_id, 'read ' || read_id as header, sequence from perfect"),
        "format_probe": over(
            "original",
            """select kind, kind as probed, count(*) as n_reads, count(quality) filter (where kind like 'FASTQ%') as n_qualities
            from original, (select unnest(['FASTA', 'FASTQ', 'FASTAGZ', 'FASTQGZ']) as kind) group by kind""",
        ),
        "pair_files": over(
            "perfect",
            """select 2 * (dense_rank() over (order by pair_id) - 1) + mate as read_id, 'read ' || read_id as header, sequence
            from (select *, count(*) over (partition by pair_id) as n from perfect) where n = 2""",
        ),
        "kmer_dump": over("places", "select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer, count(*) as count from places group by 1"),
        "genome_file": over("true_kmers", f"select code, count(*) as n from true_kmers where (read_id % {SPAN}) % 4 = 0 group by code"),
        "saved_reads": over("original", f"select read_id, sequence, quality from original where read_id >= {10 * SPAN} and read_id < {60 * SPAN}"),
        "saved_tables": over("keys", "select read_id, map_id, key from keys where map_id < 2"),
        "saved_results": over("original", "select read_id, sequence, cast(read_id % 4 as integer) as q from original"),
        "forest_file": f"select vec_id, round({_forest(10)}, 6) as probability from embeddings",
        "printed_features": _refined(
            "anchors",
            """select round(s.support, 6) as support, cast(s.coverage as double) as coverage, round(s.orig_weight / s.total, 6) as orig_share, round(near, 6) as near_support,
                round(avg_support, 6) as avg_support, round(min_support, 6) as min_support
            from near join supported s using (anchor_id, col) join props using (anchor_id) where s.anchor_base <> s.consensus""",
        ),
        "file_utilities": "select count(*) as n_lines, true as same_size, true as moved, true as removed from orders",
        "log_scan": over("single", "select ext, anchor_threshold, candidate_threshold, sample, tp, fp, fn, tn from single"),
        "ambiguous_reads": over("ambiguous", "select count(*) filter (where contains(sequence, 'N')) as n_ambiguous, count(*) as n_reads from ambiguous"),
        "exclude_ambiguous": over("ambiguous", "select read_id, sequence from ambiguous where not regexp_matches(sequence, '[^ACGT]')"),
        "read_range": over("perfect", f"select pair_id, count(*) as n_mates, min(sequence) as least from perfect where read_id >= {10 * SPAN} and read_id < {60 * SPAN} group by pair_id"),
        "gather_reads": over("perfect", f"select read_id, sequence, mate from perfect where read_id % {SPAN} = 0"),
        "revcomp": over("ambiguous", "select read_id, reverse(translate(sequence, 'ACGT', 'TGCA')) as revcomp from ambiguous"),
        "encode_2bit": over(
            "perfect",
            "select read_id, concat_ws(',', "
            + ", ".join(
                _SIGNED.format("(" + " + ".join(f"(instr('ACGT', sequence[{at + i + 1}]) - 1)::uhugeint * {4 ** (n - 1 - i)}::uhugeint" for i in range(n)) + ")")
                for at in range(0, READ, 32)
                for n in [min(32, READ - at)]
            )
            + ") as codes, sequence as decoded, cast(hamming(sequence, reverse(translate(sequence, 'ACGT', 'TGCA'))) as integer) as distance from perfect",
        ),
        "quality_weight": over(
            "original",
            f"""select q, count(*) as n, round(pow(10::double, -(ascii(q) - 33) / 10.0::double), 9) as p, round(greatest(0.001::double, 1 - pow(10::double, -(ascii(q) - 33) / 10.0::double)), 9) as w
            from (select quality[i] as q from (select quality, unnest(range(1, {READ + 1})) as i from original)) group by q""",
        ),
        "quality_from_weight": """select i, case when 1 - i / 1000.0::double < 1e-5 then 'I' else chr(cast(least(73, greatest(33, floor(-log10(1 - i / 1000.0::double) * 10 + 33 + 0.5))) as integer)) end as q
            from (select unnest(range(1, 1001)) as i)""",
        "requantized_quality": over(
            "original",
            f"""select read_id, list_aggregate(list_transform(range(1, {READ + 1}), lambda i: chr(33 + least(40, least(3, (ascii(quality[i]) - 33) // 11) * 11 + 5))), 'string_agg', '') as quality from original""",
        ),
        "murmur64": "with " + ",\n".join(f"{n} as ({b})" for n, b in _murmur({"h": "o_orderkey"}, "orders", "o_orderkey")) + " select o_orderkey, " + _SIGNED.format("h") + " as h from m5",
        "murmur32": """with a as (select o_orderkey, cast(o_orderkey as ubigint) & 4294967295::ubigint as x from orders),
            b as (select o_orderkey, (xor(x, x >> 16) * 2246822507::ubigint) & 4294967295::ubigint as x from a),
            c as (select o_orderkey, (xor(x, x >> 13) * 3266489909::ubigint) & 4294967295::ubigint as x from b)
            select o_orderkey, cast(xor(x, x >> 16) as bigint) as h from c""",
        # as one number of 96 bits
        "shifted_bits": """with n as (select o_orderkey, ((cast(o_orderkey as uhugeint) * 18446744073709551616::uhugeint + cast(o_custkey as uhugeint) * 4294967296::uhugeint
                + cast(o_orderkey + o_custkey as uhugeint)) % 576460752303423488::uhugeint) * 137438953472::uhugeint as x from orders)
            select o_orderkey, cast(x // 18446744073709551616::uhugeint as bigint) as a, cast((x // 4294967296::uhugeint) % 4294967296::uhugeint as bigint) as b,
                cast(x % 4294967296::uhugeint as bigint) as c from n""",
        "scattered_rows": """select o_orderkey as k, coalesce(v, round(o_totalprice, 2)) as v
            from orders left join (select l_orderkey, sum(l_quantity) as v from lineitem group by l_orderkey) on l_orderkey = o_orderkey""",
        "bit_members": "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as member from customer",
        "strided_ids": "select (o_orderkey - 100) // 32 as part, count(*) as n, min(o_orderkey) as least from orders where o_orderkey >= 100 group by 1",
        "canonical_kmers": over("true_kmers", "select read_id, count(*) as n, min(code) as least, max(code) as largest from true_kmers group by read_id"),
        "kmer_counts": over("true_kmers", "select code, count(*) as n from true_kmers group by code"),
        "kmer_spectrum": over("true_kmers", "select n, count(*) as n_kmers from (select code, count(*) as n from true_kmers group by code) group by n"),
        "minhash_keys": over("keys", "select read_id, map_id, key from keys"),
        "minhash_windowed": over(
            "hashed",
            f"""select read_id, window_id, map_id, key from (
                select read_id, cast((pos - 1) // 31 as integer) as window_id, unnest([0, 1]) as map_id, unnest([cast(min(h0) & {_MASK}::ubigint as bigint), cast(min(h1) & {_MASK}::ubigint as bigint)]) as key
                from m5 group by 1, 2)""",
        ),
        "bottom_n_sketch": over(
            "hashed",
            """select read_id, list_aggregate(list_transform(case when len(hs) >= 8 then hs[1:8] else list_append(hs, 18446744073709551615::ubigint) end, lambda h: cast("""
            + _SIGNED.format("h")
            + """ as varchar)), 'string_agg', ',') as sketch from (select read_id, list_sort(list(distinct h0)) as hs from m5 group by read_id)""",
        ),
        "bucket_sizes": over("sizes", "select map_id, key, n from sizes"),
        "bucket_pruned": over("pruned", "select map_id, key, string_agg(cast(read_id as varchar), ',' order by read_id) as read_ids from pruned group by map_id, key"),
        "candidate_pairs": over("pairs", "select anchor_id, cand_id from pairs"),
        "candidate_counts": over("pairs", "select anchor_id, count(*) as n_candidates from pairs group by anchor_id"),
        "paired_candidates": over(
            "pairs", "select a.anchor_id, a.cand_id, b.anchor_id is not null as is_paired from pairs a left join pairs b on b.anchor_id = xor(a.anchor_id, 1) and b.cand_id = xor(a.cand_id, 1)"
        ),
        "prefix_offsets": "select l_orderkey, n, cast(coalesce(sum(n) over (order by l_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as first from (select l_orderkey, count(*) as n from lineitem group by l_orderkey)",
        "segment_ids": "select l_orderkey, cast(unnest(range(0, n)) as integer) as place from (select l_orderkey, count(*) - 1 as n from lineitem group by l_orderkey)",
        "adjacent_unique": "select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> event_type",
        "flagged_select": """select l_orderkey, l_partkey, l_linenumber, place, row_number() over (partition by l_orderkey order by place) - 1 as rank from (
            select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as place from lineitem) where l_quantity > 25""",
        "align_shd": over("aligned", "select * from aligned"),
        "orientation_choice": over("sided", "select anchor_id, cand_id, orientation, by_estimate from sided"),
        "overlap_weight": over("aligned", f"select anchor_id, cand_id, {_SPLIT_WEIGHT} from aligned where f_valid"),
        "good_candidates": over("good", "select * from good"),
        "filtered_candidates": over(
            "good",
            """select good.* from good join (select anchor_id,
                case when count(*) filter (where n_ops / overlap < 0.06::double * 2) >= 1.8 then 0.06::double * 2 when count(*) filter (where n_ops / overlap < 0.06::double * 3) >= 1.8 then 0.06::double * 3 else 0.06::double * 4 end as most
                from good group by anchor_id) using (anchor_id) where n_ops / overlap < most""",
        ),
        "msa_columns": over("columns", "select anchor_id, col, n_a, n_c, n_g, n_t, w_a, w_c, w_g, w_t, coverage, consensus from columns"),
        "msa_columns_quality": over("columns", "select anchor_id, col, q_a as w_a, q_c as w_c, q_g as w_g, q_t as w_t, q_consensus as consensus from columns"),
        "msa_consensus": over("supported", "select anchor_id, col, consensus, round(support, 6) as support, anchor_base, orig_weight, orig_coverage from supported"),
        "msa_properties": over("judged", "select anchor_id, avg_support, min_support, min_coverage, max_coverage, failed_avg, failed_min, failed_coverage from judged"),
        "hq_anchors": over("judged", "select anchor_id, is_hq from judged"),
        "split_columns": over("many", "select anchor_id, col, letter, round(ratio, 6) as ratio from many"),
        "region_selection": over(
            "many",
            f"""select r.anchor_id, r.cand_id, f.col, r.sequence[f.col - r.shift + 1] <> a.sequence[f.col + 1] as dropped
            from (select anchor_id, min(col) as col from many group by anchor_id) f join rows r using (anchor_id) join rows a on a.anchor_id = f.anchor_id and a.cand_id is null
            where r.cand_id is not null and f.col >= r.shift and f.col < r.shift + {READ}""",
        ),
        "candidate_clusters": over(
            "many",
            f"""select anchor_id, signature, string_agg(cand_id, ',' order by cand_id) as cand_ids from (
                select r.anchor_id, r.cand_id, string_agg(case when m.col >= r.shift and m.col < r.shift + {READ} then r.sequence[m.col - r.shift + 1] else '-' end, '' order by m.col) as signature
                from (select distinct anchor_id, col from many) m join rows r using (anchor_id) where r.cand_id is not null group by r.anchor_id, r.cand_id) group by anchor_id, signature""",
        ),
        "anchor_corrections": _refined("anchors", "select read_id, is_hq, sequence from anchors"),
        "candidate_corrections": _refined("others", "select read_id, anchor_id, sequence from others"),
        "correction_edits": _refined(
            "differing",
            """select read_id, cast(len(places) as integer) as n_edits, case when len(places) <= 16 then coalesce(list_aggregate(list_transform(places, lambda i: i || now[i]), 'string_agg', ','), '') end as edits,
                case when len(places) > 16 then now end as full from differing""",
        ),
        "apply_edits": _refined("anchors", "select read_id, coalesce(a.sequence, o.sequence) as sequence from original o left join anchors a using (read_id)"),
        "refined_msa": _refined("columns", "select anchor_id, col, n_a, n_c, n_g, n_t, w_a, w_c, w_g, w_t, coverage, consensus from columns"),
        "corrected_reads": _refined("corrected", "select read_id, sequence, q from corrected"),
        "read_flags": _refined("anchors", "select read_id, case when is_hq then 1 when is_hq is null then 2 else 0 end as flag from original left join anchors using (read_id)"),
        "sort_merge_output": _refined("corrected", "select read_id, 'read ' || read_id || ' correction:q=' || q as header, c.sequence, o.quality from original o join corrected c using (read_id) order by read_id"),
        "union_inputs": over(
            "original",
            """select row_number() over (order by part, read_id) - 1 as read_id, sequence from (select 0 as part, read_id, sequence from perfect union all select 1, read_id, sequence from original)""",
        ),
        "topn": over("perfect", f"select read_id, sequence from perfect where read_id < {5 * SPAN}"),
        "forest_score": f"select vec_id, round({_forest()}, 6) as probability from embeddings",
        "forest_decide": f"select vec_id, {_forest()} >= 0.5 as accepted from embeddings",
        "eval_confusion": _refined("confusion", "select * from confusion"),
        "eval_metrics": _refined("confusion", f"select name, {_ratio('tp - fp', 'tp + fn')} as gain, {_ratio('tp', 'tp + fn')} as sensitivity, {_ratio('tn', 'tn + fp')} as specificity from confusion"),
        "eval_hist": _refined("hist", "select * from hist"),
        "eval_over": _refined("hist", "select name, cast(coalesce(sum(n_reads) filter (where n_errors > 10), 0) as bigint) as n_over from hist group by name"),
        "kmers_in_genome": _chain(*_needs("kmers"), *_needs("true_kmers"))
        + f""", counts as (select code, count(*) as n from kmers group by code),
            genome as (select distinct code from true_kmers where (read_id % {SPAN}) % 4 = 0)
            select count(*) filter (where g.code is not null) as n_in, cast(sum(n) filter (where g.code is not null) as bigint) as weight_in, count(*) as n_all, cast(sum(n) as bigint) as weight_all
            from counts left join genome g using (code)""",
        "lost_kmers": _chain(*_needs("kmers"), *_needs("true_kmers")) + "select distinct code from true_kmers where code not in (select code from kmers)",
        "last_wins": over("single", "select * from single"),
        "common_samples": over(
            "single",
            "select * from single where sample in (select sample from single group by sample having count(*) = (select count(*) from (select distinct ext, anchor_threshold, candidate_threshold from single)))",
        ),
        "required_samples": over(
            "single",
            """select single.* from single join (select ext, anchor_threshold, candidate_threshold from single where sample in ('0', '2') group by all having count(*) = 2)
            using (ext, anchor_threshold, candidate_threshold) where sample in ('0', '2')""",
        ),
        "frontier": over("totals", "").rstrip() + frontier.format(same="o.ext = t.ext") + " or (ext = 'N' and anchor_threshold = 3 and candidate_threshold = 30)",
        "frontier_global": over("totals", "").rstrip() + frontier.format(same="true"),
    }
