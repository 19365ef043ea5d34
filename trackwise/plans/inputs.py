"""Domain tables derived from the driver's tables by integer arithmetic, in SQL that Spark and DuckDB share."""

from __future__ import annotations

TRAIN = "case {u} % 3 when 0 then 'CRH380BG-5822' when 1 then 'CRH5A-5001' else 'CR400AF-B-2118' end"

#: {fmt}: the timestamp as yyyyMMddHHmmss; {div}: integer division.
CAPTURES = """select event_id, user_id, value,
  'bur' || cast(event_id % 4 as string) as bureau, """ + TRAIN.format(u="user_id") + """ as train_group, {fmt} as pass_time,
  'ST' || cast(user_id % 7 as string) as station, cast(1 + user_id % 2 as string) as row_name, cast(1 + event_id % 8 as int) as car_seq,
  cast(1 + event_id % 9 as string) as channel, cast(event_id % 1000 as int) as pic_no, lpad(cast(event_id % 1000 as string), 3, '0') as pic
  from {events}"""
NAMES = "select *, bureau || '_' || train_group || '_' || pass_time || '_' || station || '_' || row_name || '_' || cast(car_seq as string) || '_10X' || channel || pic || '.jpg' as name from ({captures}) c"

#: Boxes of classes on strips; the classes are 1 to 5, the box is filled.
COMPONENTS = """select *, min_row + h - 1 as max_row, min_col + w - 1 as max_col, cast(h * w as bigint) as px from (
  select l_orderkey as seq_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as comp_id,
    cast(1 + l_partkey % 5 as int) as class_id, cast(l_partkey * 7 % 160 as int) as min_row, cast(l_suppkey * 13 % 90 as int) as min_col,
    cast(1 + cast(l_quantity as int) % 12 as int) as h, cast(1 + cast(l_quantity as int) % 9 as int) as w
  from {lineitem}) t"""

#: Pixels of small strips, some of them next to each other.
PIXELS = "select distinct {div_event} as seq_id, cast(1 + user_id % 2 as int) as class_id, cast(event_id % 11 as int) as row, cast((user_id * 5 + event_id) % 9 as int) as col from {events}"

#: Features: the embedding times a row factor, and its reversal.
FEATURES = "select vec_id, label, embedding, cast(vec_id % 20 as bigint) as unit from {embeddings}"
