"""Schemas of the fact tables and of what surrounds them (DDL strings)."""

POINT = "struct<x:double,y:double>"
BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"
TAIL = f"origin {POINT}, bbox {BBOX}, doc_id string, page int, org_id string, fact_ord long"

#: ``value_num`` is set where the value is a number, ``value_str`` where it is text. ``fact_ord`` is the order in
#: which facts were stored: "first" always means the smallest.
UNITS = f"id string, label string, value_str string, value_num double, unit_of_measure string, context string, extraction_agreement double, {TAIL}"
BIJECTIONS = f"id string, left_set array<string>, right_set array<string>, mapping array<struct<k:string,v:string>>, {TAIL}"
CELL = f"struct<row:int,col:int,value:string,origin:{POINT}>"
GRIDS = f"id string, rows int, cols int, cells array<{CELL}>, {TAIL}"
RANGES = f"id string, label string, min double, typ double, max double, unit string, conditions string, context string, {TAIL}"
CONDITIONAL_UNITS = f"id string, label string, value double, unit string, condition_type string, condition_value string, derating string, context string, {TAIL}"
CORRECTIONS = "id long, doc_id string, canonical_id string, canonical_type string, action string, original_value string, corrected_value string, corrected_by string, notes string, created_at timestamp"
PAGE_EXTRACTIONS = "doc_id string, page int, json string"
QUESTIONS = "q_id long, doc_id string, question string"
CORPUS = "content_hash string, mpn string, chip_name string, datasheet_url string, canonical_data string, created_at timestamp"
