"""The same queries as DuckDB SQL."""

from __future__ import annotations

from trackweave.config import FIXTURE as T
from trackweave.sources.fixtures import LABELLED, SPECS

CROPS = """
c0 as (select vec_id as crop_id, label as folder, cast(vec_id % 5 as int) as local_id, vec_id // 5 as frame, embedding::DOUBLE[] as emb from embeddings),
c1 as (select *, list_transform(emb[1:32], lambda x: abs(x)) as u, list_transform(emb[33:64], lambda x: abs(x)) as l from c0),
crops as (select crop_id, folder, local_id, frame, emb, list_transform(u, lambda x: x / list_sum(u)) as up, list_transform(l, lambda x: x / list_sum(l)) as lo from c1)
"""


def protos(name: str, keys: str) -> str:
    """A group's n, frames, prototype and histograms."""
    return f"""
{name}_e as (select {keys}, list(m order by i) as m from (select {keys}, i, avg(emb[i]) as m from crops, range(1, 65) r(i) group by {keys}, i) group by {keys}),
{name}_c as (select {keys}, list(u order by i) as u, list(l order by i) as l from (select {keys}, i, sum(up[i]) as u, sum(lo[i]) as l from crops, range(1, 33) r(i) group by {keys}, i) group by {keys}),
{name}_n as (select {keys}, count(*) as n, list(distinct frame) as frames, min(frame) as frame_min, max(frame) as frame_max from crops group by {keys}),
{name} as (select *, sqrt(list_dot_product(m, m)) as coherence, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as proto,
  list_transform(u, lambda x: x / list_sum(u)) as pu, list_transform(l, lambda x: x / list_sum(l)) as pl
  from {name}_e join {name}_c using ({keys}) join {name}_n using ({keys}))
"""


TRACKS, FOLDERS = protos("tracks", "folder, local_id"), protos("folders", "folder")
LEAST = "list_sum(list_transform(list_zip({0}, {1}), lambda z: least(z[1], z[2])))"


def sims(a: str = "a", b: str = "b") -> str:
    color = f"0.4 * {LEAST.format(f'{a}.pu', f'{b}.pu')} + 0.6 * {LEAST.format(f'{a}.pl', f'{b}.pl')}"
    return f"list_dot_product({a}.proto, {b}.proto) as reid_sim, {color} as color_sim, len(list_intersect({a}.frames, {b}.frames)) as frame_overlap"


def spec_rows() -> str:
    rows = []
    for s in SPECS:
        for word in (" is ", ":", "="):
            if word in s:
                left, right = s.split(word)
                rows += [f"('{s}', {int(x)}, {int(right)})" for x in left.split(",")]
                break
    return f"specs(spec, folder1, folder2) as (values {', '.join(rows)})"


SPEC = spec_rows()

DETECTIONS = """
d0 as (select user_id % 8 as video_id, event_id as det_id, epoch_us(ts) // 600000000 - 2840112 + 1 as frame_idx, cast(user_id as int) as local_id, value as sharpness, cast(json_extract(props, '$.k') as int) as bw,
  cast((event_id * 37) % 1180 as int) as x1, cast((event_id * 53) % 520 as int) as y1 from events),
d as (select *, 2 * bw as bh, bw * 2 * bw / 921600.0::DOUBLE as area_ratio, x1 + bw as x2, y1 + 2 * bw as y2 from d0)
"""

ASPECT = "greatest(bh / greatest(1, bw), bw / greatest(1, bh))"
GATES = {
    "save_width": "bw >= 10", "save_height": "bh >= 20", "save_area": "area_ratio >= 0.0010::DOUBLE", "save_sharpness": "sharpness >= 8",
    "reid_width": "bw >= 10", "reid_height": "bh >= 20", "reid_area": "area_ratio >= 0.0012::DOUBLE", "reid_sharpness": "sharpness >= 12",
    "refine_area": "area_ratio >= 0.0012::DOUBLE", "refine_sharpness": "sharpness >= 12", "refine_aspect": f"{ASPECT} <= 4",
}
MATRIX = "g as (select det_id, " + ", ".join(f"coalesce({v}, false) as {k}" for k, v in GATES.items()) + " from d)"
FAILED = "concat_ws(', ', " + ", ".join(f"case when not {k} then '{k}' end" for k in GATES) + ")"
EVERY = " and ".join(GATES)

NAMES = """
n as (select det_id, printf('frame_%06d_t%.3f_l%d.jpg', frame_idx, frame_idx / 24.0::DOUBLE, local_id) as name from d where frame_idx >= 0
  union all select * from (values (-1, 'frame_000190_t_7.917.jpg'), (-2, 'frame_000190_t7.917_l5_1.jpg'), (-3, 'foo.jpg')))
"""


def spec_parse() -> str:
    rows = []
    for s in LABELLED:
        left, _, right = s.partition(" is ")
        rows += [f"('{s}', '{x.strip()}', '{right}', 'ok')" for x in left.split(",")] if right else [f"('{s}', null, null, 'error')"]
    folder = lambda c: f"case when regexp_full_match({c}, '[0-9]+') then printf('person_%03d', cast({c} as int)) else {c} end"
    return f"select *, {folder('\"left\"')} as left_folder, {folder('\"right\"')} as right_folder from (values {', '.join(rows)}) v(spec, \"left\", \"right\", status)"


COMPARED = f"""with {CROPS}, {FOLDERS}, {SPEC},
m as (select spec, folder1, folder2, a.n as n1, b.n as n2, greatest(a.n, b.n) >= {T.large_size} as large, {sims()} from specs join folders a on a.folder = folder1 join folders b on b.folder = folder2),
w as (select *, case when large then {T.large_reid}::DOUBLE else {T.merge_reid}::DOUBLE end as reid_threshold, case when large then {T.large_color}::DOUBLE else {T.merge_color}::DOUBLE end as color_threshold from m),
x as (select *, concat_ws(',', case when frame_overlap > {T.max_overlap} then 'frame_overlap' end, case when reid_sim < reid_threshold then 'reid_below' end, case when color_sim < color_threshold then 'color_below' end) as why from w)
select spec, folder1, folder2, n1 as folder1_count, n2 as folder2_count, round(reid_sim, 6) as reid_sim, round(color_sim, 6) as color_sim, frame_overlap, reid_threshold, color_threshold, {T.max_overlap} as max_frame_overlap,
  case when large then 'LARGE' else 'NORMAL' end as mode, why = '' as can_merge, case when why = '' then 'ok' else why end as reasons, 'ok' as status from x"""

IMAGES = f"""{SPEC}, k as (select folder, count(*) as k from crops group by folder),
s as (select specs.*, a.k * b.k <= 2000000 as fits from specs join k a on a.folder = folder1 join k b on b.folder = folder2),
p as (select spec, folder1, folder2, a.crop_id as image1, b.crop_id as image2, list_dot_product(a.emb, b.emb) as sim from s join crops a on a.folder = folder1 join crops b on b.folder = folder2 where fits)"""

IOU = """case when (a_x2-a_x1)*(a_y2-a_y1) + (b_x2-b_x1)*(b_y2-b_y1) - greatest(0, least(a_x2,b_x2)-greatest(a_x1,b_x1)) * greatest(0, least(a_y2,b_y2)-greatest(a_y1,b_y1)) > 0
  then greatest(0, least(a_x2,b_x2)-greatest(a_x1,b_x1)) * greatest(0, least(a_y2,b_y2)-greatest(a_y1,b_y1)) / ((a_x2-a_x1)*(a_y2-a_y1) + (b_x2-b_x1)*(b_y2-b_y1) - greatest(0, least(a_x2,b_x2)-greatest(a_x1,b_x1)) * greatest(0, least(a_y2,b_y2)-greatest(a_y1,b_y1)))::DOUBLE else 0.0::DOUBLE end"""

SQL = {
    "intra_track_pairs": f"""with {CROPS}, {TRACKS}, m as (select a.folder, a.local_id as track_a, b.local_id as track_b, {sims()} from tracks a join tracks b on a.folder = b.folder and a.local_id < b.local_id)
select folder, track_a, track_b, round(reid_sim, 6) as reid_sim, round(color_sim, 6) as color_sim, frame_overlap, {T.split_reid}::DOUBLE as split_reid_threshold, {T.split_color}::DOUBLE as split_color_threshold,
case when reid_sim >= {T.split_reid} and color_sim >= {T.split_color} then 'MERGED' else 'SPLIT' end as verdict from m""",
    "track_summary": f"""with {CROPS}, {TRACKS}, s as (select folder, local_id, avg(x) as mean_sim, min(x) as min_sim, max(x) as max_sim from (select folder, local_id, list_dot_product(emb, proto) as x from crops join tracks using (folder, local_id)) group by all)
select folder, local_id as track_id, n as image_count, round(mean_sim, 6) as mean_sim, round(min_sim, 6) as min_sim, round(max_sim, 6) as max_sim, round(coherence, 6) as coherence, frame_min, frame_max from tracks join s using (folder, local_id)""",
    "folder_summary": f"""with {CROPS}, {TRACKS}, {FOLDERS}, s as (select folder, avg(x) as a, min(x) as b, max(x) as c from (select folder, list_dot_product(emb, proto) as x from crops join folders using (folder)) group by folder),
o as (select a.folder, count(*) filter (len(list_intersect(a.frames, b.frames)) > 0) as k from tracks a join tracks b on a.folder = b.folder and a.local_id < b.local_id group by a.folder),
t as (select folder, count(*) as track_count from tracks group by folder)
select folder, n as image_count, track_count, frame_min, frame_max, round(a, 6) as folder_sim_mean, round(b, 6) as folder_sim_min, round(c, 6) as folder_sim_max, coalesce(k, 0) as overlap_pair_count, 'ok' as status
from folders join s using (folder) join t using (folder) left join o using (folder)""",
    "compare_summary": COMPARED,
    "compare_track_pairs": f"""with {CROPS}, {TRACKS}, {SPEC}, m as (select spec, folder1, folder2, a.local_id as track1, b.local_id as track2, {sims()} from specs join tracks a on a.folder = folder1 join tracks b on b.folder = folder2)
select spec, folder1, folder2, track1, track2, round(reid_sim, 6) as reid_sim, round(color_sim, 6) as color_sim, frame_overlap, {T.merge_reid}::DOUBLE as reid_threshold, {T.merge_color}::DOUBLE as color_threshold,
case when reid_sim >= {T.merge_reid} and color_sim >= {T.merge_color} then 'MATCH' else 'NO' end as verdict from m""",
    "compare_top_pairs": f"""with {CROPS}, {IMAGES}, r as (select *, row_number() over (partition by spec, folder1, folder2 order by sim desc, image1, image2) as k from p)
select spec, folder1, folder2, image1, image2, round(sim, 6) as sim, null::VARCHAR as note from r where k <= 5 union all
select spec, folder1, folder2, null, null, null, 'skipped: too many pairs' from s where not fits""",
    "pairwise_range": f"with {CROPS}, {IMAGES} select spec, folder1, folder2, round(min(sim), 6) as min_sim, round(max(sim), 6) as max_sim, round(avg(sim), 6) as mean_sim from p group by spec, folder1, folder2",
    "folder_manifest_diff": f"""with {CROPS}, f as (select folder, crop_id, 'crop_' || crop_id || '.jpg' as file from crops), x as (
select folder, file, 'added' as change from f where crop_id % 7 <> 0 and crop_id % 5 = 0 union all select folder, file, 'removed' from f where crop_id % 5 <> 0 and crop_id % 7 = 0)
select folder, change, count(*) as n, min(file) as first_file from x group by folder, change""",
    "track_to_folder_similarity": f"with {CROPS}, {TRACKS}, {FOLDERS}, m as (select a.folder, a.local_id, {sims()} from tracks a join folders b using (folder)) select folder, local_id, round(reid_sim, 6) as reid_sim, round(color_sim, 6) as color_sim from m",
    "pairwise_mean_offdiag": f"""with {CROPS} select a.folder, any_value(k) as n, round(avg(list_dot_product(a.emb, b.emb)), 6) as pair_mean from crops a join crops b on a.folder = b.folder and a.crop_id <> b.crop_id
join (select folder, count(*) as k from crops group by folder) c on c.folder = a.folder group by a.folder""",
    "duplicate_frames": f"with {CROPS} select folder, frame, count(*) as n from crops where frame >= 0 group by folder, frame having count(*) > 1",
    "save_gate": f"with {DETECTIONS} select det_id, frame_idx, local_id from d where bw >= 10 and bh >= 20 and area_ratio >= 0.0010::DOUBLE and sharpness >= 8",
    "reid_gate": f"with {DETECTIONS} select det_id, coalesce(bw >= 10 and bh >= 20 and area_ratio >= 0.0012::DOUBLE and sharpness >= 12, false) as reid_ok from d",
    "stage_a_gate": f"""with {DETECTIONS} select det_id, coalesce(bw >= 10 and bh >= 20 and sharpness >= 12 and {ASPECT} <= 4, false) as stage_a,
coalesce(bw >= 10 and bh >= 20 and area_ratio >= 0.0012::DOUBLE and sharpness >= 12 and {ASPECT} <= 4, false) as stage_a_area, coalesce(area_ratio >= 0.0012::DOUBLE and sharpness >= 12 and {ASPECT} <= 4, false) as track_gate from d""",
    "gate_matrix": f"with {DETECTIONS}, {MATRIX} select * from g",
    "gate_pass_counts": f"with {DETECTIONS}, {MATRIX} " + " union all ".join(f"select '{k}' as gate, count(*) filter ({v}) as passed, count(*) filter (not ({v})) as failed from g" for k, v in [*((k, k) for k in GATES), ("all", EVERY)]),
    "failed_gate_list": f"with {DETECTIONS}, {MATRIX} select det_id, {FAILED} as failed, case when {EVERY} then 'all' when {' or '.join(GATES)} then 'some' else 'none' end as class from g",
    "metric_histogram": f"""with {DETECTIONS}, e as (select min(sharpness) as lo, max(sharpness) as hi from d)
select cast(least(case when hi > lo then floor((sharpness - lo) / (hi - lo) * 30) else 15 end, 29) as int) as bin, count(*) as n from d, e where sharpness is not null group by 1""",
    "label_gate_examples": f"with {DETECTIONS}, {MATRIX}, u as (" + " union all ".join(f"select '{k}' as gate, det_id from g where not {k}" for k in GATES) + ") select gate, det_id from (select *, row_number() over (partition by gate order by det_id) as k from u) where k <= 2",
    "crop_name_parse": f"""with {DETECTIONS}, {NAMES}, s as (select *, regexp_replace(name, '\\.[^.]*$', '') as stem from n)
select det_id, name, coalesce(try_cast(nullif(regexp_extract(stem, 'frame_(\\d+).*_l(\\d+)', 1), '') as int), -1) as frame, coalesce(try_cast(nullif(regexp_extract(stem, 'frame_(\\d+).*_l(\\d+)', 2), '') as int), -1) as local_id,
coalesce(try_cast(nullif(regexp_extract(stem, 'frame_(\\d+)', 1), '') as int), -1) as frame_only from s""",
    "crop_name_format": f"with {DETECTIONS}, {NAMES} select * from n",
    "pair_spec_parse": spec_parse(),
    "even_sample": f"""with {CROPS}, f as (select folder, printf('crop_%08d.jpg', crop_id) as name from crops), r as (select *, row_number() over (partition by folder order by name) - 1 as p, count(*) over (partition by folder) as n from f)
select folder, name from r where n <= 7 or p in (select floor(i * (r.n - 1) / 6.0) from range(7) t(i))""",
    "every_n": f"with {DETECTIONS} select det_id, frame_idx from d where ((frame_idx % 3) + 3) % 3 = 0",
    "bbox_iou": f"""with {DETECTIONS}, p as (select det_id, x1 as a_x1, y1 as a_y1, x2 as a_x2, y2 as a_y2, lead(x1) over w as b_x1, lead(y1) over w as b_y1, lead(x2) over w as b_x2, lead(y2) over w as b_y2 from d window w as (partition by local_id order by frame_idx, det_id))
select det_id, round({IOU}, 6) as iou from p where b_x1 is not null""",
    "safe_crop": f"""with {DETECTIONS}, s as (select det_id, greatest(0, least(x1 - 600, 319)) as a, greatest(0, least(y1 - 260, 179)) as b, greatest(0, least(x2 - 600, 320)) as c, greatest(0, least(y2 - 260, 180)) as e from d)
select det_id, case when c > a and e > b then a end as cx1, case when c > a and e > b then b end as cy1, case when c > a and e > b then c end as cx2, case when c > a and e > b then e end as cy2 from s""",
    "aspect_area": f"with {DETECTIONS} select det_id, x2 - x1 as w, y2 - y1 as h, round(area_ratio, 9) as area_ratio, round({ASPECT}, 6) as aspect, round(frame_idx / 24.0::DOUBLE, 6) as seconds from d",
    "iou_pairs_same_frame": f"""with {DETECTIONS}, f as (select floor(frame_idx / 6) as frame_idx, det_id, x1, y1, x2, y2 from d), p as (select a.frame_idx, a.det_id as a_id, b.det_id as b_id, a.x1 as a_x1, a.y1 as a_y1, a.x2 as a_x2, a.y2 as a_y2, b.x1 as b_x1, b.y1 as b_y1, b.x2 as b_x2, b.y2 as b_y2
from f a join f b on a.frame_idx = b.frame_idx and a.det_id % 2 = 0 and b.det_id % 2 = 1)
select cast(frame_idx as bigint) as frame_idx, a_id, b_id, round(iou, 6) as iou from (select *, {IOU} as iou from p) where iou >= 0.1""",
    "identity_map_last_wins": f"with {CROPS} select frame, local_id, max(folder) as person_id from crops group by frame, local_id",
    "identity_overlay": f"""with {CROPS}, {DETECTIONS}, m as (select frame as frame_idx, local_id, max(folder) as person_id from crops group by frame, local_id), o as (select det_id, frame_idx, local_id % 5 as local_id, y1 from d)
select det_id, o.frame_idx, o.local_id, person_id, coalesce('P' || person_id, '?') as label, case when person_id is null then 'L' || o.local_id || ' ?' else printf('P%03d L%d', person_id, o.local_id) end as review_label, greatest(y1 - 10, 20) as text_y, case when y1 > 24 then y1 - 10 else y1 + 20 end as review_y
from o left join m on m.frame_idx = o.frame_idx and m.local_id = o.local_id""",
    "id_hue": f"with {DETECTIONS} select distinct local_id, cast(floor((local_id * 0.61803398875::DOUBLE - floor(local_id * 0.61803398875::DOUBLE)) * 179) as int) as hue from d",
    "top_tracks": f"with {DETECTIONS} select local_id, count(*) as n, count(distinct frame_idx) as frames from d group by local_id order by n desc, local_id limit 10",
    "frame_gap": f"with {DETECTIONS} select det_id, local_id, frame_idx - lag(frame_idx) over (partition by local_id order by frame_idx, det_id) as gap from d",
    "gap_frames": """select video_id, fps, cast(greatest(1, round_even(fps * 3.0::DOUBLE, 0)) as bigint) as short_gap, cast(greatest(greatest(1, round_even(fps * 3.0::DOUBLE, 0)) * 2, round_even(fps * 8.0::DOUBLE, 0)) as bigint) as stale
from (values (0::BIGINT, 10.0::DOUBLE), (1, 24.0), (2, 0.1), (3, 30.0), (4, 30.0), (5, 29.97)) v(video_id, fps)""",
}

#: A greedy walk over a frame's pairs p (frame_idx, k: their order, a, b), which takes a pair if both its sides are free.
WALK = """walk as (select distinct frame_idx, 0::bigint as k, []::bigint[] as xs, []::bigint[] as ys from p
union all select w.frame_idx, w.k + 1, case when list_contains(w.xs, p.a) or list_contains(w.ys, p.b) then w.xs else list_append(w.xs, p.a) end,
case when list_contains(w.xs, p.a) or list_contains(w.ys, p.b) then w.ys else list_append(w.ys, p.b) end from walk w join p on p.frame_idx = w.frame_idx and p.k = w.k + 1),
taken as (select frame_idx, unnest(xs) as a, unnest(ys) as b from (select frame_idx, arg_max(xs, k) as xs, arg_max(ys, k) as ys from walk group by frame_idx))"""
MATCHED = f"""with recursive {CROPS}, {DETECTIONS}, o as (select * exclude (rn) from (select *, row_number() over (partition by frame_idx, local_id order by det_id) as rn from d) where rn = 1),
f as (select cast(floor(o.frame_idx / 6) as int) as frame_idx, det_id, o.local_id, folder as person_id, emb, up, lo, y1 from o join crops on crop_id = det_id % (select count(*) from crops)),
s as (select a.frame_idx, a.det_id as a, b.det_id as b, b.person_id, b.local_id, list_dot_product(a.emb, b.emb) as reid,
0.4 * list_sum(list_transform(list_zip(a.up, b.up), lambda x: least(x[1], x[2]))) + 0.6 * list_sum(list_transform(list_zip(a.lo, b.lo), lambda x: least(x[1], x[2]))) as color
from f a join f b on a.frame_idx = b.frame_idx and a.det_id % 2 = 0 and b.det_id % 2 = 1),
p as (select *, row_number() over (partition by frame_idx order by round(reid + 0.2 * color, 9) desc, a, person_id, local_id, b) as k from s where reid >= 0.05 and color >= 0.6), {WALK}"""
FOLDER_REPORT = f"""select folder, 'track' as section, track_id::bigint as a, null::bigint as b, image_count::bigint as n, min_sim as low, max_sim as high, mean_sim as value, null::varchar as told from ({SQL["track_summary"]})
union all select folder, 'track to folder', local_id, null, null, null, color_sim, reid_sim, null from ({SQL["track_to_folder_similarity"]})
union all select folder, 'pair', track_a, track_b, frame_overlap, null, color_sim, reid_sim, verdict from ({SQL["intra_track_pairs"]})"""
PAIR_REPORT = f"""select spec, folder1, folder2, 'verdict' as section, null::bigint as a, null::bigint as b, frame_overlap::bigint as n, null::double as low, color_sim as high, reid_sim as value, reasons as told from ({SQL["compare_summary"]})
union all select spec, folder1, folder2, 'pair', track1, track2, frame_overlap, null, color_sim, reid_sim, verdict from ({SQL["compare_track_pairs"]})
union all select spec, folder1, folder2, 'images', image1, image2, null, null, null, sim, null from ({SQL["compare_top_pairs"]}) where image1 is not null
union all select spec, folder1, folder2, 'range', null, null, null, min_sim, max_sim, mean_sim, null from ({SQL["pairwise_range"]})"""
SQL |= {
    "greedy_frame_match": f"{MATCHED} select t.frame_idx, t.a as det_id, t.b as sample_id, p.person_id, round(p.reid, 6) as reid_sim from taken t join p on p.frame_idx = t.frame_idx and p.a = t.a and p.b = t.b",
    "review_overlay": f"""{MATCHED}, m as (select t.a, p.person_id from taken t join p on p.frame_idx = t.frame_idx and p.a = t.a and p.b = t.b)
select det_id, cast(floor(frame_idx / 6) as int) as frame_idx, person_id, case when person_id is null then 'L' || local_id || ' ?' else printf('P%03d L%d', person_id, local_id) end as review_label,
cast(case when y1 > 24 then y1 - 10 else y1 + 20 end as int) as review_y from o left join m on m.a = det_id where det_id % 2 = 0""",
    "greedy_iou_match": f"""with recursive {DETECTIONS}, f as (select cast(floor(frame_idx / 6) as bigint) as frame_idx, det_id, x1, y1, x2, y2 from d),
q as (select a.frame_idx, a.det_id as a_id, b.det_id as b_id, a.x1 as a_x1, a.y1 as a_y1, a.x2 as a_x2, a.y2 as a_y2, b.x1 as b_x1, b.y1 as b_y1, b.x2 as b_x2, b.y2 as b_y2 from f a join f b on a.frame_idx = b.frame_idx and a.det_id % 2 = 0 and b.det_id % 2 = 1),
p as (select frame_idx, a_id as a, b_id as b, row_number() over (partition by frame_idx order by a_id, iou desc, b_id) as k from (select *, {IOU} as iou from q) where iou >= 0.1), {WALK}
select t.frame_idx, 'both' as kind, a as a_id, b as b_id, {", ".join(f"cast((x.{c} + y.{c}) // 2 as int) as {c}" for c in ("x1", "y1", "x2", "y2"))} from taken t join f x on x.det_id = t.a join f y on y.det_id = t.b
union all select frame_idx, 'only_a', det_id, null, x1::int, y1::int, x2::int, y2::int from f where det_id % 2 = 0 and not exists (select 1 from taken where a = det_id)
union all select frame_idx, 'only_b', null, det_id, x1::int, y1::int, x2::int, y2::int from f where det_id % 2 = 1 and not exists (select 1 from taken where b = det_id)""",
    "online_overlay": f"""with {CROPS}, {DETECTIONS}, m as (select frame as frame_idx, local_id, max(folder) as gid from crops group by frame, local_id),
o as (select det_id, o.local_id, gid, y1, cast(floor((gid * 0.61803398875::DOUBLE - floor(gid * 0.61803398875::DOUBLE)) * 179) as int) as h from (select det_id, frame_idx, local_id % 5 as local_id, y1 from d) o left join m on m.frame_idx = o.frame_idx and m.local_id = o.local_id),
c as (select *, cast(floor(h / 30) as int) as s, 255 * (1 - 220 / 255::DOUBLE) as p, 255 * (1 - 220 / 255::DOUBLE * (h / 30 - floor(h / 30))) as q, 255 * (1 - 220 / 255::DOUBLE * (1 - (h / 30 - floor(h / 30)))) as t from o)
select det_id, 'L:' || local_id as local_text, coalesce('G:' || gid, 'G:?') as global_text, case when y1 > 24 then y1 - 10 else y1 + 20 end as local_y, case when y1 > 24 then y1 + 8 else y1 + 38 end as global_y,
coalesce(cast(round([p, p, t, 255, 255, q][s + 1]) as int), 0) as b, coalesce(cast(round([t, 255, 255, q, p, p][s + 1]) as int), 165) as g, coalesce(cast(round([255, q, p, p, t, 255][s + 1]) as int), 255) as r from c""",
    "deep_folder_report": FOLDER_REPORT,
    "deep_pair_report": PAIR_REPORT,
}
