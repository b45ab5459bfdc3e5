"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        with said as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
        escaped as (
            select *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) as body,
                length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) as head from said)
        select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text), '')) as loss_sha256,
            sum(4 + head + 3 + body + 9)::bigint as formatted_chars
        from escaped group by conv_id""",
    "op4_warc": """
        select page_id, bytes as payload_bytes, digest as payload_digest, case when revisits then 'revisit' else 'response' end as record_type,
            case when revisits then best end as refers_to
        from (select *, bytes >= 1000 and page_id < best as revisits from (
            select page_id, strlen(coalesce(html, ''))::bigint as bytes, sha1(coalesce(html, '')) as digest, max(page_id) over (partition by coalesce(html, '')) as best from pages))""",
    "op10_quality_rules": r"""
        with split as (
            select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
        words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
        windows as (
            select * from (select doc_id, i, w as a, lead(w, 1) over o as b, lead(w, 2) over o as c from words window o as (partition by doc_id order by i)) where c is not null),
        twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as n from windows) where n > 1),
        covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by doc_id),
        stats as (
            select s.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(ls) as n_lines,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) as upper, length(regexp_replace(t, '[^a-z]', '', 'g')) as lower
            from split s left join covered c on c.doc_id = s.doc_id),
        judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats)
        select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
            n_repeat_words::bigint as n_repeat_words, base_failed, not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
                or 10 * n_dup_lines > 3 * n_lines or 2 * upper > greatest(1, upper + lower)) as kept
        from judged""",
}
