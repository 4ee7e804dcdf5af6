"""The registered queries as DuckDB SQL, where SQL can express them; grouped kernels and fuzzy ratios have tests instead."""

from __future__ import annotations

_BOX = "event_id*37%960 as x1, event_id*53%560 as y1"
_PORTS = f"ports as (select user_id as image, event_id as port_id, case when event_id%3=0 then 'connected' else 'empty' end as state, {_BOX} from events)"
_DEVICES = """devices as (select o_custkey//10 as image, o_orderkey as dev_id, case when o_orderkey%40=0 then 'switch' else 'patch_panel' end as kind,
  o_orderkey*17%500 as px, o_orderkey*29%300 as py from orders)"""
_ASSIGNED = f"""with {_PORTS}, {_DEVICES}, pairs as (
  select p.image, port_id, dev_id, kind,
    (least(x1+12, px+400) - greatest(x1, px)) as w, (least(y1+10, py+200) - greatest(y1, py)) as h, x1, y1, px, py
  from ports p join devices d on p.image = d.image),
reasons as (select image, port_id, dev_id, kind, case when 100*w*h >= 85*120 and 2*x1+12 between 2*px and 2*px+800 and 2*y1+10 between 2*py and 2*py+400
    and 100*(y1+10-py) <= 95*200 then 'Valid' else 'Port not contained' end as reason from pairs where w > 0 and h > 0),
ranked as (select *, row_number() over (partition by image, port_id order by case when reason='Valid' then 0 else 1 end, case when kind='switch' then 0 else 1 end, dev_id) as rn from reasons),
assigned as (select p.image, p.port_id, p.state, case when r.reason='Valid' then r.kind end as parent_type, case when r.reason='Valid' then r.dev_id end as parent_id,
    coalesce(r.reason, 'Orphaned Port') as validation from ports p left join ranked r on p.image=r.image and p.port_id=r.port_id and r.rn=1)"""
_DET = f"det as (select user_id as image, event_id as det_id, event_type as class, event_id*31%1000/1000.0::double as confidence, {_BOX} from events)"
_BASE = """base as (select vec_id, embedding, label, [8,12,16,20,24,28,48][vec_id%7+1] as ports, vec_id%3+1 as rows_, ['LEFT','RIGHT','CENTER','MIXED','NONE'][vec_id%5+1] as arrangement from embeddings)"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


_JOBS = "jobs as (select 'job_' || o_orderkey as job_id, o_custkey::varchar as user_id, case when o_orderstatus='F' then 'done' else 'waiting' end as status, o_orderdate as created_at, o_orderkey from orders)"
_LINES = """with l as (select l_orderkey as doc, l_linenumber, l_partkey, l_suppkey, 'c' || l_returnflag as cable, case when l_returnflag='R' then 'N/A' else l_returnflag end as cable_description,
  case when l_returnflag='R' or l_linestatus='O' then 'n/a' else 'net' end as usage, l_partkey::varchar as port, l_suppkey::varchar as port_description, l_linenumber::varchar as other_port,
  coalesce(o_orderpriority='1-URGENT', false) as urgent from lineitem join orders on l_orderkey=o_orderkey),
numbered as (select *, row_number() over (partition by doc order by l_linenumber, l_partkey, l_suppkey) as ord from l)"""
_STRIP = r"regexp_replace(%s, '<[^>]*>', '', 'gs')"

SQL: dict[str, str] = {
    "port_parent_assignment": f"{_ASSIGNED} select * replace (parent_id::varchar as parent_id) from assigned",
    "port_counts_per_device": f"{_ASSIGNED} select image, parent_id, count(*) filter (state='connected') as n_connected, count(*) filter (state='empty') as n_empty from assigned where parent_id is not null group by all",
    "nested_device_ports": f"""{_ASSIGNED} select d.image, d.dev_id, count(*) filter (state='connected') as n_connected, count(*) filter (state='empty') as n_empty
        from devices d left join assigned a on a.image=d.image and a.parent_id=d.dev_id group by all""",
    "unit_labels": f"""with {_DET}, units as (select o_custkey//10 as image, o_orderkey as unit_no, o_orderkey*17%700 as ux, o_orderkey*29%400 as uy from orders),
        pairs as (select u.image, unit_no, class, confidence, det_id, (least(x1+200,ux+220)-greatest(x1,ux)) as w, (least(y1+90,uy+80)-greatest(y1,uy)) as h from units u join det d on u.image=d.image),
        hit as (select *, row_number() over (partition by image, unit_no order by confidence desc, det_id) as rn from pairs where w>0 and h>0 and (w*h)::double/(220*80+200*90-w*h) > 0.25)
        select u.image, u.unit_no, coalesce(class,'empty') as label, round(coalesce(confidence,0.0),6) as confidence from units u left join hit h on u.image=h.image and u.unit_no=h.unit_no and rn=1""",
    "unit_ordinals": f"with {_DET} select image, det_id, row_number() over (partition by image order by y1, x1, det_id)::int as unit_no from det",
    "best_rack": """with r as (select o_custkey%150 as image, o_orderkey as det_id, 0.6*(o_orderkey*7%1000/1000.0::double) + 0.4*least((o_orderkey*13%400+20)*200/1e5::double, 1.0) as score from orders)
        select image, arg_max(det_id, (score, -det_id)) as det_id, round(max(score),6) as score from r group by image""",
    "class_thresholds": f"""with {_DET}, t as (select * from (values ('view','rack',0.3),('click','switch',0.44),('purchase','patch_panel',0.44),('signup','cable',0.18)) v(a,b,c))
        select coalesce(b, class) as class, count(*) as n from det left join t on class=a where confidence >= coalesce(c, 0.2)::double group by 1""",
    "box_clamp": f"""with {_DET}, c as (select det_id, greatest(x1-10,0)::int as x1, greatest(y1-10,0)::int as y1, least(x1+210,959)::int as x2, least(y1+100,559)::int as y2 from det) select * from c where x2>x1 and y2>y1""",
    "latest_status": 'select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as "at" from events group by 1',
    "model_match_cascade": f"""with {_BASE}, p as (select q.vec_id as image, r.vec_id as rid, q.label, {_dot('q.embedding','r.embedding')} / (sqrt({_dot('q.embedding','q.embedding')})*sqrt({_dot('r.embedding','r.embedding')})) as s,
          q.vec_id%11*4 as np, r.ports, q.rows_ = r.rows_ as f2, q.arrangement = r.arrangement as f3
          from base q join base r on q.label=r.label and q.vec_id<>r.vec_id),
        near as (select np, p from (select np, p, row_number() over (partition by np order by abs(p-np), p) as rn from (select distinct vec_id%11*4 as np from embeddings), unnest([8,12,16,20,24,28,48]) t(p)) where rn<=3),
        a as (select p.*, np=0 or exists(select 1 from near n where n.np=p.np and n.p=p.ports) as f1 from p),
        b as (select * from (select *, bool_or(f1) over (partition by image) as any1 from a) where f1 or not any1),
        c as (select * from (select *, bool_or(f2) over (partition by image) as any2 from b) where f2 or not any2),
        d as (select * from (select *, bool_or(f3) over (partition by image) as any3 from c) where f3 or not any3),
        e as (select *, row_number() over (partition by image order by s desc, rid) as rn from d)
        select image, 'Vendor ' || label as vendor, 'ref' || lpad(rid::varchar, 6, '0') as filename, round(s, 6) as similarity from e where rn=1""",
    "two_stage_topk": f"""with p as (select q.vec_id as q_id, r.vec_id as r_id, {_dot('q.embedding[1:8]','r.embedding[1:8]')} as cheap, {_dot('q.embedding','r.embedding')} as score
          from embeddings q join embeddings r on q.label=r.label and q.vec_id<>r.vec_id),
        k as (select *, row_number() over (partition by q_id order by cheap desc, r_id) as rn from p),
        f as (select *, row_number() over (partition by q_id order by score desc, r_id) as r2 from k where rn<=5)
        select q_id, r_id, round(score,6) as score from f where r2=1""",
    "phash_near": """with e as (select label, vec_id, vec_id * 2654435761 % 4294967296 as h from embeddings),
        r as (select label, vec_id, h, ((h << 8) & 4294967295) | (h >> 24) as t from e),
        p as (select x.label, x.vec_id as a, y.vec_id as b, least(bit_count(xor(x.h, y.h)), bit_count(xor(x.h, y.t)))::int as distance from e x join r y on x.label = y.label and x.vec_id < y.vec_id)
        select *, greatest(0.0, 1 - distance / 32)::double as similarity from p where distance <= 8""",
    "input_images": """with p as (select unnest(['input/a.PNG','images/b.jpg','input/images/c.Tiff','output/rack/d.jpeg','output/e.bmp','other/deep/f.webp','input/notes.txt']) as relative, unnest(range(7)) as k, unnest(['input','images','input/images','output/rack','output','other/deep',null]) as folder),
        f as (select distinct o_orderkey, k, folder, relative from orders join p on k in (o_orderkey % 7, o_orderkey // 7 % 7) where k < 6), m as (select o_orderkey, min(k) as k from f group by 1)
        select 'job_' || o_orderkey as job_id, folder, relative from f join m using (o_orderkey, k)""",
    "keyed_dedup": """select p_partkey, p_brand, p_type, p_size from (select *, row_number() over (partition by lower(trim(p_brand)), lower(trim(p_type)), lower(trim(p_size::varchar)) order by p_partkey) as rn from part) where rn=1""",
    "content_dedup": "select doc_id, lang from (select *, row_number() over (partition by md5(text) order by doc_id) as rn from documents) where rn=1",
    "vendor_exact_vote": r"""with v as (select * from (values (0,'the of'),(1,'and'),(2,'les'),(3,'der'),(4,'que'),(5,'with'),(6,'inor')) t(ord,vendor)),
        l as (select doc_id, unnest(string_split(text, chr(10))) as part from documents),
        n as (select doc_id, part, trim(regexp_replace(regexp_replace(translate(replace(lower(part),'\n',' '),'01','ol'),'[^a-z0-9\s-]',' ','g'),'\s+',' ','g')) as p from l),
        d as (select distinct p, list_distinct(string_split(p,' ')) as x from n where p<>''),
        s as (select p, ord, vendor, (case when contains(p,vendor) then 1.0 else 0.0 end)::double + 0.6::double*len(list_intersect(x, string_split(vendor,' ')))/len(string_split(vendor,' ')) as score from d, v),
        b as (select p, arg_max(vendor,(score,-ord)) as vendor, arg_max(ord,(score,-ord)) as ord, max(score) as score from s group by p having max(score)>=0.2),
        k as (select doc_id, vendor, ord, sum(score) as total, count(*) as votes from n join b using(p) group by all)
        select doc_id as image, arg_max(vendor,(round(total,3),votes,-ord)) as vendor, round(max(round(total,3)),3) as total, arg_max(votes,(round(total,3),votes,-ord)) as votes from k group by 1""",
    "port_count_parse": r"""with m as (select p_partkey, (case p_partkey%3 when 0 then 'WS-C' when 1 then 'GS' else 'DGS-' end) || p_partkey || '-' || p_size || 'T' as model from part)
        select p_partkey, model, coalesce(coalesce(nullif(regexp_extract(model,'-(\d{2})([A-Z]|$)',1),''), nullif(regexp_extract(model,'(GS|DGS|SGD|XS|XGS)\D*(\d{2})$',2),''), nullif(regexp_extract(model,'\d{2}(\d{2})$',1),''))::int, -1) as ports from m""",
    "model_regex_extract": r"""with t as (select p_partkey, upper(concat_ws(' ', p_name, p_brand, 'WS-C' || p_partkey)) as s from part),
        m as (select p_partkey, unnest(regexp_extract_all(s,'WS-C[0-9]+')) as v, 100 as b from t union all select p_partkey, unnest(regexp_extract_all(s,'[A-Z]+#[0-9]+')), 10 from t)
        select p_partkey, arg_max(v,(length(v)+b, v)) as model, max(length(v)+b)::int as score from m where length(v)>=4 and regexp_matches(v,'[A-Z]') and regexp_matches(v,'[0-9]') group by 1""",
    "lookup_cascade": """with d as (select * from (values (0,'promoplated','c1'),(1,'small','c2'),(2,'standardx','c3'),(3,'economy','c4')) t(ord,port,cable)),
        p as (select p_partkey, p_type as port_class, regexp_replace(lower(p_type),'[^a-z0-9]','','g') as k from part),
        h as (select p_partkey, port_class, case when k=port then 0 when contains(k,port) or contains(port,k) then 1
            when contains(k,'sc') and starts_with(port,'sc') then 4 when contains(k,'lc') and starts_with(port,'lc') then 5 end as rule, cable, ord from p, d),
        b as (select p_partkey, port_class, arg_min(rule,(rule,ord)) as rule, arg_min(cable,(rule,ord)) as cable from h where rule is not null group by all)
        select p.p_partkey, p.port_class, coalesce(rule, -1)::int as rule, cable from p left join b using(p_partkey)""",
    "cable_labels": """select p_partkey, case p_partkey%12 when 0 then 'RJ45' when 1 then 'HDMI' when 2 then 'LC' when 3 then 'SC' when 4 then 'BNC' when 5 then 'USB' when 6 then 'PS/2' when 7 then 'NEMA' when 8 then 'RS-232'
        when 9 then 'SFP' when 10 then 'XFP' else 'Other_B' || substr(lower(p_brand),2) end as label from part""",
    "description_lookup": """select c_custkey, case when c_custkey%7=0 then 'nowhere' else lower(n_name) end as name, case when c_custkey%7=0 then 'N/A' else 'nation ' || n_nationkey end as description from customer join nation on c_nationkey=n_nationkey""",
    "missing_mappings": r"""with k as (select p_size, lower(p_name || ' ' || p_brand) as key from part) select distinct key from k where key not in (select key from k where p_size>25)""",
    "html_text": r"""with b as (select page_id, coalesce(nullif(regexp_extract(html,'(?is)<body[^>]*>(.*?)</body>',1),''), html) as h from pages)
        select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(h,'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>',' ','g'),'(?s)<[^>]*>',' ','g'),'\s+',' ','g'))) as text_md5 from b""",
    "html_meaningful": rf"""select page_id, case when regexp_matches(html,'(?i)<img\b|<picture\b|data:image/') then true
        when regexp_matches(html,'(?i)<table\b') then len(list_filter(regexp_extract_all(html,'(?is)<tr[^>]*>(.*?)</tr>',1)[2:], lambda r: length(trim({_STRIP % 'r'}))>3))>0
        else length(trim({_STRIP % 'html'}))>30 end as meaningful from pages""",
    "category_order": """with c(k, name, category, rank) as (values (0,'rack report','rack',0), (1,'Switch_x','switch',1), (2,'patch panel','patchpanel',2), (3,'cables','cable',3), (4,'ports-results','empty_port',4), (5,'Connected port','connected_port',5),
          (6,'panel',null,999), (7,'PatchPanel','patchpanel',2), (8,'empty-port','empty_port',4), (9,'connected',null,999), (10,'empty',null,999))
        select page_id, category, row_number() over (partition by page_id%10 order by rank, lower(name || '_' || page_id))::int as position from pages join c on k = page_id%11""",
    "section_spans": """with h as (select conv_id, turn, role, coalesce(lead(turn) over (partition by conv_id order by turn, role), max(turn) over (partition by conv_id)+1) as e from conversations)
        select conv_id, role as section, max(turn) as start, arg_max(e, turn) as "end" from h group by 1,2""",
    "line_pairs": """with l as (select conv_id, turn, role, length(text) as n, lead(role) over w as r2, lead(length(text)) over w as n2 from conversations window w as (partition by conv_id order by turn))
        select conv_id, turn, n::varchar as first, n2::varchar as second from l where role='user' and r2='assistant'""",
    "line_cleaning": r"""with l as (select doc_id, trim(regexp_replace(unnest(string_split(text,chr(10))),'\s+',' ','g')) as line from documents)
        select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars from l where line<>'' and len(string_split(line,' '))>4 group by 1""",
    "leaf_label_scan": r"""with l as (select event_id, json_extract_string(props,'$.k') as k from events)
        select event_id, concat_ws(',', case when regexp_matches(k,'^[0-9]{2,}$') then 'long' end, case when contains(k,'1') then 'one' end, case when contains(k,'7') then 'seven' end) as labels from l""",
    "colour_tokens": "select p_partkey, case p_partkey%7 when 0 then 'Black,Blue' when 1 then 'White,Blue' when 2 then 'Green,Blue' when 3 then 'Grey,Blue' when 4 then 'Yellow,Blue' when 5 then 'Red,Blue' else 'Teal,Blue' end as colours from part",
    "confidence_bands": f"with {_DET} select class, case when confidence>=0.75 then 'high' when confidence>=0.4 then 'medium' else 'low' end as band, count(*) as n from det group by all",
    "layout_stats": f"""with {_PORTS}, n as (select image, count(*) as num_ports, count(*) filter (2*x1+12 < 972) as l from ports group by 1)
        select image, num_ports, case when 5*l>=3*num_ports then 'LEFT' when 5*(num_ports-l)>=3*num_ports then 'RIGHT' else 'CENTER' end as arrangement from n""",
    "upload_validation": """with f as (select o_custkey, ['multi','single','video'][o_custkey%3+1] as t, o_orderkey from orders),
        g as (select o_custkey as upload_id, t as upload_type, count(*) as n_files, bool_and(t='video' or o_orderkey%17<>0) as ok from f group by all)
        select upload_id, upload_type, n_files, ok and n_files <= case t when 'multi' then 20 else 1 end as ok from (select *, upload_type as t from g)""",
    "job_history": f"with {_JOBS} select job_id, user_id, case o_orderkey%5 when 0 then 'rack/img.jpg' when 1 then 'switch/img.jpg' when 2 then 'cable/img.jpg' end as image from jobs where status='done' and o_orderkey%4 in (0,3)",
    "gallery": """select 'job_' || o_orderkey as job_id, case o_orderkey%5 when 1 then 'switch/img.jpg' else 'units/unit1/switch/img.jpg' end as relative, case o_orderkey%5 when 1 then 'img.jpg' else 'unit1 - img.jpg' end as label from orders where o_orderkey%5 in (1,3)""",
    "job_logs": """select 'job_' || o_orderkey as job_id, count(l_orderkey) as n_messages, coalesce(string_agg(l_returnflag || l_linestatus, '' order by l_linenumber, l_returnflag || l_linestatus),'') as all_messages
        from orders left join lineitem on l_orderkey=o_orderkey group by o_orderkey""",
    "latest_job": """with b as (select o_custkey::varchar as user_id, 'job_' || o_orderkey as job_id, o_orderdate as "at", case when o_orderstatus='F' then 0 else 1 end as prio from orders),
        r as (select *, row_number() over (partition by user_id order by prio, "at" desc, job_id) as rn from b)
        select user_id, job_id, "at", case prio when 0 then 'table' else 'files' end as found_in from r where rn=1""",
    "job_status_counts": f"with {_JOBS} select status, count(*) as n from jobs group by 1",
    "tile_grid": """with p as (select p_partkey, p_partkey*7%900+50 as w, p_partkey*11%500+50 as h from part),
        s as (select *, greatest(w-200,0) as r, greatest(h-200,0) as b from p),
        xs as (select p_partkey, w, h, r, b, unnest(range(0, r+1, 160)) as x from s), ys as (select p_partkey, unnest(range(0, b+1, 160)) as y from s),
        t as (select p_partkey, x, y, w, h from xs join ys using(p_partkey) union all select p_partkey, x, b, w, h from xs where h%160<>0
          union all select p_partkey, r, y, w, h from s join ys using(p_partkey) where w%160<>0 union all select p_partkey, r, b, w, h from s)
        select p_partkey, count(*) as n_tiles, sum(x)::bigint as sum_x1, sum(y)::bigint as sum_y1, sum(least(x+200,w))::bigint as sum_x2, sum(least(y+200,h))::bigint as sum_y2 from t group by 1""",
    "nearest_ports": """select p_partkey, array_to_string(list_transform(list_sort(list_transform([8,12,16,20,24,28,48], lambda p: {'d': abs(p-p_size), 'p': p}))[1:3], lambda s: s.p), ',') as ports from part""",
    "representative_crop": """with d as (select user_id, event_id as crop_id, 0.6::double*(event_id*97%100000)/1e6 + 0.4::double*least(1.0::double, (event_id*89%1500)/1000.0::double) as s from events)
        select user_id, arg_max(crop_id,(s,-crop_id)) as crop_id, round(max(s),6) as score from d group by 1""",
    "ordinals": r"""select p_partkey, p_partkey || case when p_partkey%100 between 11 and 13 then 'th' when p_partkey%10=1 then 'st' when p_partkey%10=2 then 'nd' when p_partkey%10=3 then 'rd' else 'th' end as ordinal,
        regexp_replace(lower(p_name),'[^a-z0-9]','','g') as alnum, lower(trim(regexp_replace(translate(p_brand,'_-','  '),'\s+',' ','g'))) as spaced,
        trim(regexp_replace(regexp_replace(translate(lower(p_brand),'01','ol'),'[^a-z0-9\s-]',' ','g'),'\s+',' ','g')) as ocr, lower(regexp_replace(p_type,'[^a-zA-Z0-9\\s]','','g')) as compact,
        trim(regexp_replace(lower(p_brand),'[^a-z0-9]+','_','g'),'_') as model_key from part""",
    "report_tables": """select n_regionkey, md5('<html><body><h1>Nations</h1><table><tr><th>n_name</th><th>n_nationkey</th></tr>' || chr(10) ||
        string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', chr(10) order by n_nationkey) || '</table></body></html>') as html_md5 from nation group by 1""",
    "panel_models": r"""select p_partkey, case p_partkey%7 when 0 then 'RJ_45' when 1 then 'LC_UPC' when 2 then 'SC_UPC' when 3 then 'MPO' when 4 then 'Keystone' else p_size || '_port' end as model from part""",
    "text_guess": """select p_partkey, case p_partkey%3 when 0 then 'Cisco unit' when 1 then 'by ZTE' end as vendor, p_name as model, 'a long description of ' || p_type as description from part""",
    "description_cascade": r"""with d as (select p_partkey as ord, lower(p_brand) as v, trim(regexp_replace(lower(p_name),'[^a-z0-9]+','_','g'),'_') as m, p_type || ' ' || p_size as d from part where p_size>40),
        f as (select p_partkey, lower(p_brand) as v, trim(regexp_replace(lower(case when p_partkey%5=0 then substr(p_name,1,4) else p_name end),'[^a-z0-9]+','_','g'),'_') as m from part),
        d1 as (select v, m, arg_max(d, ord) as d1 from d group by all), d2 as (select m, arg_min(d, ord) as d2, min(ord) as o from d group by all),
        d3 as (select k.m, arg_min(d2, o) as d3 from (select distinct m from f) k join d2 on contains(d2.m, k.m) group by all)
        select p_partkey, coalesce(d1, d2, d3) as description from f left join d1 using (v, m) left join d2 using (m) left join d3 using (m)""",
    "vendor_resolution": """with n as (select n_nationkey as ord, n_name as known, regexp_replace(lower(n_name),'[^a-z0-9]','','g') as k from nation),
        f as (select c_custkey, regexp_replace(lower(case c_custkey%3 when 0 then n_name when 1 then 'x-' || n_name || '.' else substr(n_name,1,4) end),'[^a-z0-9]','','g') as f from customer join nation on c_nationkey=n_nationkey),
        h as (select c_custkey, known, ord, case when f=k then 0 when contains(f,k) then 1 when contains(k,f) then 2 end as rule from f, n),
        r as (select *, row_number() over (partition by c_custkey order by rule, ord) as rn from h where rule is not null)
        select f.c_custkey, known, coalesce(rule,-1)::int as rule from f left join r on r.c_custkey=f.c_custkey and rn=1""",
    "kept_units": "select o_orderkey, o_orderkey%3 as n_switch, o_orderkey%2 as n_panel, o_orderkey%5 as n_ports from orders where o_orderkey%5>0 and (o_orderkey%3>0) <> (o_orderkey%2>0)",
    "parent_resolution": f"""with {_PORTS}, {_DEVICES}, dev as (select distinct image, dev_id from devices where dev_id%60=0),
        fd as (select image, min(dev_id) as fd from dev group by 1),
        ins as (select p.image, port_id, min(dev_id) as around from ports p join devices d on p.image=d.image where (least(x1+12,px+400)-greatest(x1,px))>0 and (least(y1+10,py+200)-greatest(y1,py))>0
          and 100*(least(x1+12,px+400)-greatest(x1,px))*(least(y1+10,py+200)-greatest(y1,py)) >= 85*120 and 2*x1+12 between 2*px and 2*px+800 and 2*y1+10 between 2*py and 2*py+400 and 100*(y1+10-py) <= 95*200 group by all)
        select p.image as doc, p.port_id, coalesce(dev.dev_id, fd, around)::varchar as resolved, case when dev.dev_id is not null then 'parent_id' when fd is not null then 'first_device' when around is not null then 'box' end as rule
        from ports p left join dev on dev.image=p.image and p.port_id%2=0 and dev.dev_id = p.port_id%750*20 left join fd on fd.image=p.image left join ins on ins.image=p.image and ins.port_id=p.port_id""",
    "parent_resolution_lists": f"""with {_PORTS}, {_DEVICES}, dev as (select distinct image, dev_id from devices where dev_id%60=0),
        fd as (select image, min(dev_id) as fd, min(dev_id::varchar) as holder from dev group by 1),
        ins as (select p.image, port_id, min(dev_id) as around from ports p join devices d on p.image=d.image where (least(x1+12,px+400)-greatest(x1,px))>0 and (least(y1+10,py+200)-greatest(y1,py))>0
          and 100*(least(x1+12,px+400)-greatest(x1,px))*(least(y1+10,py+200)-greatest(y1,py)) >= 85*120 and 2*x1+12 between 2*px and 2*px+800 and 2*y1+10 between 2*py and 2*py+400 and 100*(y1+10-py) <= 95*200 group by all)
        select p.image as doc, p.port_id, case when dev.dev_id is not null then dev.dev_id::varchar when fd is not null and state='connected' then holder else coalesce(fd, around)::varchar end as resolved,
          case when dev.dev_id is not null then 'parent_id' when fd is not null and state='connected' then 'port_list' when fd is not null then 'first_device' when around is not null then 'box' end as rule
        from ports p left join dev on dev.image=p.image and p.port_id%2=0 and dev.dev_id = p.port_id%750*20 left join fd on fd.image=p.image left join ins on ins.image=p.image and ins.port_id=p.port_id""",
    "vendor_hits": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as part from documents),
        n as (select doc_id as image, trim(regexp_replace(regexp_replace(translate(replace(lower(part),'\n',' '),'01','ol'),'[^a-z0-9\s-]',' ','g'),'\s+',' ','g')) as p from l),
        h as (select image, unnest([case when contains(p,'with') or contains(p,'and') then 'w' end, case when contains(p,'der') then 'd' end, case when contains(p,'the of') then 't' end]) as vendor from n where p<>'')
        select image, vendor, count(*) as hits from h where vendor is not null group by 1,2""",
    "current_job": f"""with {_JOBS}, done as (select * from jobs where status='done'),
        s as (select c_custkey::varchar as user_id, case when c_custkey%3=0 then 'job_' || (c_custkey*4) end as job_id from customer),
        t as (select user_id, job_id, row_number() over (partition by user_id order by created_at desc, job_id desc) as rn from done),
        f as (select job_id from jobs order by created_at desc nulls last, job_id desc limit 1)
        select s.user_id, coalesce(d.job_id, t.job_id, f.job_id) as job_id, case when d.job_id is not null then 'session' when t.job_id is not null then 'table' else 'folder' end as found_in
        from s left join (select distinct job_id from done) d on d.job_id=s.job_id left join t on t.user_id=s.user_id and t.rn=1 cross join f""",
    "connected_rows": f"""{_LINES} select doc, ord, cable, cable_description, usage, port, port_description, other_port from numbered
        where not urgent and not (lower(cable_description)='n/a' and usage='n/a')""",
    "empty_rows": f"""{_LINES} select doc, ord, case when cable='cR' then 'SFP' else 'Ethernet' end as type from numbered""",
}
