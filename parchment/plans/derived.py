"""Tables that rules of documents, runs and reviews need, derived from the supplied ones: a text of SQL that Spark and DuckDB both read.

They stand in for what a word processor or a reviewer would give; each has a row for each row of a supplied table, and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    # The line items of a customer as the paragraphs of a document: headings, typed numbers of all forms, references and plain text.
    "lines": (
        """select doc, ord, case when form = 0 then c - 1 end as heading, band,
            case form when 0 then case band2 when 0 then 'Exhibit A' when 1 then 'SIGNATURES' when 2 then 'Terms and Definitions' when 3 then 'Payment: what is due' else 'Heading' end
                when 1 then concat(a, '. ', said) when 2 then concat(a, '.', b, ' ', said) when 3 then concat(a, '.', b, '.', c, ' ', said) when 4 then concat('(', chr(cast(96 + letter as int)), ') ', said)
                when 5 then concat('(', case a when 1 then 'i' when 2 then 'ii' when 3 then 'iii' else 'iv' end, ') ', said) when 6 then concat(chr(cast(64 + a as int)), '. ', said) when 7 then concat('Section ', a, ': ', said) when 8 then concat(a, ') of, the item') else said end as text
        from (select *, case band2 when 0 then 'item' when 1 then 'Goods And Services' when 2 then 'see Annex 1 for the terms of this item and for what follows from it in all of these cases' when 3 then 'PRICES FIXED, see below. And more' when 4 then 'Print Name ______ Date ______'
            when 5 then 'In witness  whereof they sign' when 6 then 'Delivery Terms: within days' when 7 then 'the price of the goods that follow:' else 'a sentence that is longer than all that a trail holds of it, and ends. Then more' end as said
        from (select o_custkey as doc, cast(row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as ord, cast((l_partkey + l_suppkey) % 10 as int) as form,
            cast(l_quantity as int) % 4 + 1 as a, l_linenumber as b, cast(l_suppkey % 3 + 1 as int) as c, cast(l_partkey % 3 as int) as band, cast(l_partkey % 9 as int) as band2, case when l_suppkey % 3 = 0 then 1 else cast(l_quantity as int) % 26 + 1 end as letter
            from lineitem join orders on l_orderkey = o_orderkey) w) x""",
        ("lineitem", "orders"),
    ),
    # The line items of an order as the items of a run: the model's answer, the text, the review. Some break a constraint.
    "items": (
        """select run_id, case when p % 97 = 0 then 'c1' else concat('c', ord) end as chunk_id, case when s % 89 = 0 then 'd0' else document_id end as document_id, ord, outcome, label, type_key, case when label = 'Non-clause' and s % 23 <> 0 then null when q % 4 = 0 then concat('s', q % 3) end as sub_type,
            case when outcome = 'failed' and s % 29 <> 0 then null when q = 50 and p % 2 = 0 then cast(1.2 as double) else cast(q as double) / 50 end as confidence, case p % 4 when 0 then '' when 1 then 'term' when 2 then 'term|notice' else 'indemnity' end as expected, source_text,
            case when merged_before then rtrim(text_before) || chr(10) || source_text when q % 5 = 0 then concat('edited ', q) when q % 7 = 0 then '' end as edited, q % 3 = 0 as flagged, decision, case decision when 'accepted' then label when 'corrected' then 'Clause' end as r_label,
            case decision when 'accepted' then type_key when 'corrected' then case when p % 3 <> 0 then 'notice' end end as r_type, case when q % 2 = 0 then 's' end as r_sub, case when decision = 'rejected' then case when p % 2 = 0 then 'why' else '' end end as note, deleted, case when merges then concat('c', ord + 1) end as merged_into
        from (select *, lag(merges) over (partition by run_id order by ord) as merged_before, lag(source_text) over (partition by run_id order by ord) as text_before from (
            select *, case when outcome = 'failed' then case when s % 13 = 0 then 'Clause' end when s % 47 = 0 then null when outcome = 'classified' and p % 5 = 0 then 'Non-clause' else 'Clause' end as label,
                case when outcome <> 'classified' then case when s % 31 = 0 then 'term' end else case s % 6 when 0 then 'term' when 1 then 'liability' when 2 then 'indemnity' when 3 then 'notice' when 4 then 'heading' end end as type_key,
                case when s % 17 = 0 then ' ' when s % 19 = 0 then null else concat('text ', p, case when q % 3 = 0 then '  ' else '' end) end as source_text, p % 3 = 0 and s % 2 = 0 as merges from (
                select concat('r', l_orderkey) as run_id, concat('d', l_orderkey) as document_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as ord, l_partkey as p, l_suppkey as s, cast(l_quantity as int) as q,
                    case when l_partkey % 11 = 0 then 'failed' when l_partkey % 7 = 0 then 'unclassified' else 'classified' end as outcome, case l_suppkey % 5 when 0 then 'accepted' when 1 then 'corrected' when 2 then 'rejected' end as decision, l_partkey % 3 = 0 as deleted from lineitem) b) c) d""",
        ("lineitem",),
    ),
    # What a reviewer submits for line items; absent fields are not in `present`.
    "submitted": (
        """select concat(l_orderkey, '/', ord) as sid, concat('r', l_orderkey) as run_id, concat('c', ord) as chunk_id, case q % 5 when 0 then '' when 1 then 'label,type' when 2 then 'label' when 3 then 'type' else 'label,type,sub' end as present,
            case p % 5 when 0 then 'Wrong' when 1 then 'Non-clause' when 2 then '' else 'Clause' end as label, case s % 4 when 0 then 'term' when 1 then 'notice' when 2 then '' else 'liability' end as type_key, case when p % 2 = 0 then concat('s', q % 3) end as sub_type
        from (select l_orderkey, l_partkey as p, l_suppkey as s, cast(l_quantity as int) + 1 as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as ord from lineitem) b""",
        ("lineitem",),
    ),
    # The paragraphs of a document as they were last synchronised.
    "records": (
        """select l_orderkey as document_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as paragraph_id, l_partkey % 3 = 0 as is_modified, case when l_suppkey % 4 <> 0 then cast(l_suppkey as int) end as synced_at, case when l_partkey % 5 <> 0 then concat('v', l_partkey) end as vector_id, l_returnflag = 'R' as deleted from lineitem""",
        ("lineitem",),
    ),
    # A customer's orders as the runs over a document.
    "runs": (
        """select *, case when o % 11 = 0 then '' when o % 13 <> 0 then concat('h', o % 3) end as hash from (select o_custkey as document_id, o_orderkey as o, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as attempt, case when o_orderstatus = 'O' then 'failed' else 'succeeded' end as status, o_custkey % 17 = 0 as deleted,
            case when o_orderkey % 5 = 0 then 'b1' else 'b2' end as build, case when o_orderkey % 7 = 0 then 2 else 3 end as schema_v, case when o_orderkey % 9 <> 0 then cast(o_orderkey % 50 as int) end as mtime, case when o_custkey % 8 <> 0 then cast(o_custkey % 60 as int) end as seen_mtime,
            cast(o_orderkey % 4 as int) as micro, cast(case when o_orderkey % 6 = 0 then o_orderkey % 2 else o_orderkey % 4 end as int) as rows_n, cast(case when o_orderkey % 10 = 0 then o_orderkey % 4 when o_orderkey % 3 = 0 then 1 else 0 end as int) as failed_n from orders) r""",
        ("orders",),
    ),
    # Customers as known documents, and what a walk over the folders found: renamed, moved and touched files, new ids, new files, and some not at all.
    "known_files": ("select concat('d', c_custkey) as document_id, concat('f', c_custkey) as file_id, c_name as name, case when c_custkey % 41 = 0 then null else concat('x', c_nationkey) end as folder, cast(c_custkey % 7 as int) as mtime, c_custkey % 13 = 0 as deleted from customer", ("customer",)),
    "seen_files": (
        """select concat(case when c_custkey % 12 = 1 then 'n' else 'f' end, c_custkey) as file_id, case when c_custkey % 5 = 0 then concat(c_name, ' 2') else c_name end as name, concat('x', case when c_custkey % 9 = 0 then c_nationkey + 1 else c_nationkey end) as folder, cast(case when c_custkey % 4 = 0 then c_custkey % 7 + 1 else c_custkey % 7 end as int) as mtime
            from customer where c_nationkey <> 3 and c_custkey % 6 <> 2 union all select concat('s', s_suppkey), s_name, concat('x', s_nationkey), 1 from supplier where s_nationkey > 3""",
        ("customer", "supplier"),
    ),
    "walked": ("select concat('x', n_nationkey) as folder from nation where n_regionkey = 0", ("nation",)),
    # What was asked of a model, and its answers: a user's events. Some answers are missing, given twice, empty, or to ids nobody asked for.
    "asked": ("select user_id as call_id, concat('p', row_number() over (partition by user_id order by ts, event_id)) as id from events", ("events",)),
    "answers": (
        """select call_id, case when k % 53 = 0 then 'p0' else concat('p', case when event_type = 'view' and k % 3 = 0 then n - 1 else n end) end as id, 'Clause' as label, event_type as type_key, cast(null as string) as sub_type, case when k % 37 = 0 then cast(1.4 as double) else cast(k as double) / 100 end as confidence, case when k % 17 = 0 then ' ' when k % 19 = 0 then null else event_type end as reason
        from (select user_id as call_id, row_number() over (partition by user_id order by ts, event_id) as n, event_type, cast(floor(value) as int) % 100 as k from events) e where event_type <> 'error'""",
        ("events",),
    ),
    # Single values for scalar functions, in the column v.
    "chunk_ids": ("select concat('chunk_', l_orderkey, '.', l_linenumber, case l_partkey % 4 when 0 then '_micro' when 1 then '_macro' when 2 then '_a_b' else '_' end) as v from lineitem", ("lineitem",)),
    "trails": ("select concat(r_name, ' > ', n_name, case when c_custkey % 3 = 0 then '' else concat(' > ', c_name) end, case when c_custkey % 7 = 0 then ' > ' else '' end) as v from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", ("customer", "nation", "region")),
    "answered": ("select case user_id % 4 when 0 then concat('```json ', props, ' ```') when 1 then props when 2 then event_type else concat('so {', chr(10), '\"all\": ', props, '} and {more}. Done') end as v from events", ("events",)),
    "params": ("select case user_id % 9 when 0 then concat(' ', event_id % 300, ' ') when 1 then concat('-', event_id % 9) when 2 then '' when 3 then case event_type when 'view' then 'TRUE' when 'click' then ' no ' when 'error' then '0' when 'signup' then 'Yes' else 'maybe' end when 4 then concat('[\"', event_type, '\",\"', event_id, '\"]') when 5 then event_type when 6 then concat(event_id, '.5') else cast(event_id % 300 as string) end as v from events", ("events",)),
    "ids": ("select case c_custkey % 4 when 0 then h when 1 then upper(h) when 2 then substr(h, 1, 30) else concat(h, '0') end as v from (select c_custkey, concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-', substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12)) as h from customer) c", ("customer",)),
    "times": ("select concat(substr(cast(o_orderdate as string), 1, 10), case o_orderkey % 5 when 0 then 'T03:04:05+02:00' when 1 then 'T03:04:05' when 2 then 'T23:59:59.250Z' when 3 then '' else 'T00:00:00-11:30' end) as v from orders", ("orders",)),
    "names": ("select case page_id % 4 when 0 then url when 1 then concat(' ', upper(url), '.docx') when 2 then '???.docx' else concat('Terms of ', page_id, ' (v2)/final.docx') end as v from pages", ("pages",)),
    # A paragraph for each line item, which may hold up to three clauses.
    "paragraphs": (
        """select l_orderkey as doc, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as ord, concat(
            case l_suppkey % 4 when 0 then '' when 1 then 'Short' when 2 then 'The supplier shall deliver the goods that are described above' else 'Each party keeps "Secret Things" to itself' end, case l_partkey % 5 when 0 then '. ' when 1 then '; ' when 2 then ' ' when 3 then '.) ' else '.' end,
            case cast(l_quantity as int) % 6 when 0 then '2.1' when 1 then 'Section 4' when 2 then '2.1.3.' when 3 then 'Clause IV(a).' when 4 then '7.' else '1.10' end, case l_partkey % 7 when 0 then ' Payment Terms. ' when 1 then ' the parties agree. ' when 2 then ' "Business Day" means a day. ' when 3 then ' NOTICES: ' when 4 then ' Fees and Payment Terms. ' when 5 then ' A Very Long Phrase That Has More Than Eight Words Here. ' else ' ' end,
            case l_suppkey % 3 when 0 then 'It is due within thirty days of the invoice' when 1 then 'So' else 'All of this holds as long as the contract does' end, '. 3.', l_linenumber, ' Delivery. The goods go to the place that the buyer names', case when l_partkey % 2 = 0 then '.' else ', and no further' end) as text from lineitem""",
        ("lineitem",),
    ),
    # Folders (region, nation, customer) and their files (orders; each is also listed in the next customer's folder). A region is listed once more inside of its first nation, so that walks meet a cycle.
    "folders": (
        """select concat('r', r_regionkey) as id, cast(null as string) as parent, r_name as name from region union all select concat('n', n_nationkey), concat('r', n_regionkey), n_name from nation union all select concat('c', c_custkey), concat('n', c_nationkey), c_name from customer
            union all select concat('r', n_regionkey), concat('n', min(n_nationkey)), 'again' from nation group by n_regionkey""",
        ("region", "nation", "customer"),
    ),
    "files": ("select concat('o', o_orderkey) as id, concat('c', o_custkey) as parent, o_totalprice as size from orders union all select concat('o', o_orderkey), concat('c', o_custkey + 1), o_totalprice + 1 from orders where o_orderkey % 3 = 0", ("orders",)),
    # The state of a user's record after each event: nested JSON whose fields come and go.
    "states": (
        """select user_id as doc, cast(row_number() over (partition by user_id order by ts, event_id) as int) as n, concat('{"k": ', cast(floor(value) as int) % 3, case when event_id % 2 = 0 then concat(', "type": "', event_type, '"') else '' end, case when event_id % 3 = 0 then ', "gone": null' else '' end,
            case when event_id % 5 < 3 then concat(', "at": {"v": ', cast(floor(value) as int) % 2, case when event_id % 4 = 0 then ', "deep": {"x": [1, 2]}' else '' end, '}') else ', "at": 5' end, '}') as state from events""",
        ("events",),
    ),
    # Orders as the rows of a document list; several have one name but for case and spaces, some have none.
    "listed": (
        """select o_orderkey as id, case when o_orderkey % 23 = 0 then ' ' when o_orderkey % 29 = 0 then null when o_orderkey % 3 = 0 then concat('Order ', o_custkey) else concat(' ORDER ', o_custkey, ' ') end as name, concat('x', o_custkey % 25) as folder, case when o_custkey % 5 = 0 then concat('Title ', o_orderkey % 100) end as title,
            case when o_orderkey % 6 = 0 then concat('Party ', o_custkey % 50) end as parties, case when o_custkey % 4 <> 0 then concat('User ', o_custkey % 9) end as reviewer, case when o_orderkey % 31 = 0 then concat('User ', o_orderkey % 7) end as current_reviewer, case o_orderkey % 7 when 0 then 'Draft' when 1 then 'Saved' when 2 then 'Reviewed' when 3 then 'Published' when 4 then 'Needs review' when 5 then 'In review' else 'Updated to vector DB' end as status,
            case o_orderpriority when '1-URGENT' then 'published' when '2-HIGH' then 'classified' when '3-MEDIUM' then 'extracted' when '4-NOT SPECIFIED' then 'extracted_with_warnings' else 'rejected' end as extraction_status, case o_orderstatus when 'F' then 'in_review' when 'O' then 'pending' else 'reviewed' end as review_status, case when o_orderkey % 13 <> 0 then cast(o_orderkey % 12 as int) end as pages,
            cast(o_orderkey % 3 as int) as needs_review, o_orderkey % 19 = 0 as warned, o_orderkey % 5 <> 0 as has_run, o_orderkey % 17 = 0 as deleted, concat('agreement ', o_custkey % 6) as agreement, concat('sector ', o_custkey % 4) as sector, o_orderdate as created, o_orderkey % 11 = 0 as changed, o_orderkey % 10 = 0 as refused, o_orderkey % 4 = 1 as due from orders""",
        ("orders",),
    ),
    # A model's answers as they come, one an event: types by name in any case, titles with quotes and stops, blank reasons.
    "model_items": (
        """select user_id as call_id, event_id as id, case when event_id % 4 = 0 then 'Non-clause' else 'Clause' end as label, case when event_id % 11 = 0 then null when event_id % 3 = 0 then upper(event_type) when event_id % 13 = 0 then 'nothing' else event_type end as canonical_type,
            case event_id % 5 when 0 then ' "The  Title." ' when 1 then null when 2 then ' ''. ' when 3 then repeat('long title ', 30) else concat('Title ', event_id % 7, ':;') end as sub_type, cast(floor(value) as int) % 100 as confidence, case when event_id % 17 = 0 then '  ' when event_id % 19 = 0 then null else concat(' because  of ', event_type, ' ') end as reason from events""",
        ("events",),
    ),
    # Classification runs of documents, some still open, and what each was made with.
    "class_runs": (
        """select o_custkey as document_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as attempt, case when o_orderkey % 10 = 3 then 'running' when o_orderstatus = 'O' then 'failed' else 'succeeded' end as status, case when o_orderkey % 6 = 0 then 't1' else 't2' end as taxonomy, case when o_orderkey % 8 = 0 then 'p1' else 'p2' end as prompt,
            case when o_orderkey % 9 = 0 then 'm1' else 'm2' end as model, substr(md5(cast(o_orderkey % 3 as string)), 1, 8) as prompt_hash, o_orderkey % 100 as least_confidence, o_orderkey % 7 as parse_ms, case when o_orderkey % 4 <> 0 then o_orderkey % 90 end as chunk_ms, case when o_orderkey % 5 <> 0 then o_orderkey % 70 end as classify_ms, o_orderkey % 3 = 0 as is_current from orders""",
        ("orders",),
    ),
    # The line items of an order as cells of its tables; some share a cell, some are blank, some are of no table or column.
    "cells": (
        """select l_orderkey as doc, case when l_suppkey % 17 <> 0 then cast(l_suppkey % 2 as int) end as tab, l_linenumber - 1 as r, case when l_partkey % 13 <> 0 then cast(l_partkey % 4 as int) end as col, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as int) as ord,
            case l_partkey % 5 when 0 then ' ' when 1 then null else concat(' t', l_suppkey, ' ') end as text from lineitem""",
        ("lineitem",),
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, needs = TABLES[name]
    text = text.replace("{", "{{").replace("}", "}}")  # braces name the frames below
    return spark.sql(f"with {', '.join(f'{n} as (select * from {{{n}}})' for n in needs)} select * from ({text}) t", **{n: load(spark, sf_dir, n) for n in needs})


def derived_sql(*names: str) -> str:
    """The start of a query over derived tables: `with recursive name as (...), ...`."""
    return "with recursive " + ", ".join(f"{n} as ({TABLES[n][0]})" for n in names)
