"""SQL twins of :mod:`tesserae.catalog.fixtures` and of the shared expressions."""

from __future__ import annotations

from tesserae.functions.text import SHORT_ESCAPES, SPACE, control_escapes


def strip(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '\A{SPACE}+', ''), '{SPACE}+\z', '')"


# The letters beyond lower-casing that the given and added texts hold, with their folded form.
FOLDED = (("ß", "ss"), ("ς", "σ"), ("\u00b5", "\u03bc"), ("\ufb01", "fi"), ("\u0149", "\u02bcn"), ("\u01f0", "j\u030c"))


def norm(e: str) -> str:
    out = f"lower(trim(regexp_replace(coalesce({e}, ''), '{SPACE}+', ' ', 'g')))"
    for letter, folded in FOLDED:
        out = f"replace({out}, '{letter}', '{folded}')"
    return out


def js(e: str) -> str:
    """JSON string literal of ``e``."""
    out = f"""replace(replace({e}, '\\', '\\\\'), '"', '\\"')"""
    for char, escape in SHORT_ESCAPES:
        out = f"replace({out}, chr({ord(char)}), '{escape}')"
    for char, escape in control_escapes():
        if ord(char):
            out = f"replace({out}, chr({ord(char)}), '{escape}')"
    return f"""('"' || {out} || '"')"""


def text_of(e: str) -> str:
    """Option text of a letter in the qa fixture."""
    return (
        f"(CASE {e} WHEN 'A' THEN opt_a WHEN 'B' THEN opt_b WHEN 'C' THEN opt_c "
        "WHEN 'D' THEN opt_d END)"
    )


def answer_label(answer: str) -> str:
    """Label meant by an answer, over the four options of the qa fixture."""
    text = strip(f"coalesce({answer}, '')")
    bare = rf"regexp_extract(upper({text}), '\A\(?([A-Z])\)?[.)]?\z', 1)"
    prefix = rf"(?s)\A\(?([A-Z])\)?[.)]{SPACE}*(.+)\z"
    label = f"regexp_extract({text}, '{prefix}', 1)"
    body = f"regexp_extract({text}, '{prefix}', 2)"
    hits = " + ".join(f"({norm(f'opt_{c}')} = {norm(text)})::INT" for c in "abcd")
    first = " ".join(
        f"WHEN {norm(f'opt_{c}')} = {norm(text)} THEN '{c.upper()}'" for c in "abcd"
    )
    return f"""(CASE WHEN NOT closed OR {text} = '' THEN NULL
      WHEN {bare} IN ('A','B','C','D') THEN {bare}
      WHEN {label} <> '' THEN CASE WHEN {label} IN ('A','B','C','D')
           AND {norm(body)} = {norm(text_of(label))} THEN {label} END
      WHEN {hits} = 1 THEN CASE {first} END END)"""


_WORD = "['short','medium','long','huge'][({}) + 1]"

_S = "(CASE WHEN n_chars < 850 THEN 0 WHEN n_chars < 1500 THEN 1 WHEN n_chars < 2700 THEN 2 ELSE 3 END)"

QA = f"""qa AS (
  SELECT doc_id, 'doc:' || doc_id AS sample_id, source AS image_id, 'img_' || doc_id AS img,
    lang AS task, source, text AS question,
    CASE WHEN doc_id % 10 = 0 THEN 'test_tiny' ELSE 'test' END AS split,
    {', '.join(f"CASE WHEN doc_id % 5 <> 0 THEN {_WORD.format(f'({i} + doc_id % 4) % 4')} END AS opt_{c}" for i, c in enumerate('abcd'))},
    CASE WHEN doc_id % 5 = 0 THEN {_WORD.format(_S)}
         ELSE chr((65 + ({_S} - doc_id % 4 + 4) % 4)::INT) END AS gold,
    {_WORD.format(_S)} AS gold_text, doc_id % 5 <> 0 AS closed, n_chars
  FROM documents)"""


def predictions(name: str = "predictions", mul: int = 7, add: int = 3) -> str:
    c = f"((doc_id * {mul} + {add}) % 11)"
    after = "chr((65 + (ascii(gold) - 65 + 1) % 4)::INT)"
    nxt = ("CASE gold_text WHEN 'huge' THEN 'short' WHEN 'short' THEN 'medium' "
           "WHEN 'medium' THEN 'long' ELSE 'huge' END")
    return f"""{name} AS (
  SELECT doc_id, sample_id, CASE WHEN {c} = 1 THEN 'invalid' ELSE 'ok' END AS status,
    CASE WHEN closed THEN CASE WHEN {c} IN (1,2) THEN gold WHEN {c} = 3 THEN '(' || gold || ')'
      WHEN {c} = 4 THEN lower(gold) || '.' WHEN {c} = 5 THEN gold || ') ' || upper(gold_text)
      WHEN {c} = 6 THEN '  ' || upper(gold_text) || chr(9) WHEN {c} = 7 THEN {after}
      WHEN {c} = 8 THEN {after} || ') ' || gold_text WHEN {c} = 9 THEN 'Answer: ' || gold ELSE '' END
    ELSE CASE WHEN {c} IN (1,2,3) THEN gold_text
      WHEN {c} IN (4,5,6) THEN ' ' || upper(gold_text) || chr(10) WHEN {c} IN (7,8) THEN {nxt}
      WHEN {c} = 9 THEN 'Answer: ' || gold_text ELSE '' END END AS pred_answer,
    'run0' AS run_hash, doc_id % 16 AS shard
  FROM qa WHERE {c} <> 0)"""


def judged(name: str = "judged", preds: str = "predictions") -> str:
    """Closed questions with predicted label and verdict."""
    return f"""{name}_p AS (
  SELECT q.*, p.sample_id IS NULL AS missing, coalesce(p.status = 'ok', false) AS valid,
    CASE WHEN p.status = 'ok' THEN p.pred_answer ELSE '' END AS pred_answer
  FROM qa q LEFT JOIN {preds} p USING (sample_id)),
{name} AS (
  SELECT *, coalesce(predicted = gold, false) AS correct
  FROM (SELECT *, CASE WHEN valid THEN {answer_label('pred_answer')} END AS predicted
        FROM {name}_p WHERE closed))"""


_IMAGE = ("CASE WHEN label % 2 = 0 THEN label::VARCHAR "
          "ELSE label::VARCHAR || '_' || (vec_id % 16)::VARCHAR END")

REGIONS = f"""regions AS (
  SELECT vec_id, {_IMAGE} AS image_id, lpad(vec_id::VARCHAR, 10, '0') AS region_id,
    vec_id % 8 * 4096 AS x, vec_id // 8 * 4096 AS y,
    CASE WHEN label = 8 THEN 1 ELSE 4096 END::BIGINT AS width,
    CASE WHEN label = 8 THEN 1 ELSE 4096 END::BIGINT AS height,
    512::BIGINT AS output_width, 512::BIGINT AS output_height, 'generic ' || vec_id AS description,
    embedding::DOUBLE[] AS vector, label
  FROM embeddings)"""

SLIDES = """slides AS (
  SELECT 'slide_' || p_partkey AS image_id, p_partkey,
    (4096 * (1 + p_size % 9) + p_partkey * 37 % 4096)::BIGINT AS width,
    (4096 * (1 + p_partkey * 13 % 7) + p_partkey * 53 % 4096)::BIGINT AS height,
    CASE p_partkey % 4 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS slide_mpp,
    CASE WHEN p_partkey % 4 = 2 THEN 40 END AS objective_power,
    CASE WHEN p_partkey % 4 = 3 THEN 0.5::DOUBLE END AS assumed_mpp,
    CASE WHEN p_partkey % 17 = 5 THEN 'roi' ELSE 'wsi' END AS input_kind
  FROM part)"""

SCALED = """scaled AS (
  SELECT *, coalesce(slide_mpp, 10.0::DOUBLE / objective_power, assumed_mpp) AS mpp,
    CASE WHEN slide_mpp IS NOT NULL THEN 'slide_metadata'
      WHEN objective_power IS NOT NULL THEN 'objective_power_conversion'
      WHEN assumed_mpp IS NOT NULL THEN 'assumed' ELSE 'unknown' END AS mpp_source
  FROM slides)"""

IMAGE_ROWS = """image_rows AS (
  SELECT o_orderkey AS order_id, 'ord:' || o_orderkey AS sample_id,
    lpad(o_custkey::VARCHAR, 12, '0') AS image_id, o_orderkey % 3 <> 0 AS closed,
    o_orderpriority AS task,
    CASE WHEN o_orderkey % 997 = 0 THEN 'rare' ELSE o_orderstatus END AS answer_text,
    'clerk' || (o_custkey % 7) AS source
  FROM orders)"""

ORDER_IMAGES = """order_images AS (
  SELECT lpad(c_custkey::VARCHAR, 12, '0') AS image_id,
    4096 * (1 + c_custkey % 9) + c_custkey * 37 % 4096 AS width,
    4096 * (1 + c_custkey * 13 % 7) + c_custkey * 53 % 4096 AS height,
    CASE WHEN c_custkey % 17 = 5 THEN 'roi' ELSE 'wsi' END AS input_kind
  FROM customer)"""

CALLS = """model_calls AS (
  SELECT event_id, ts, user_id::VARCHAR AS case_id, event_type AS stage, value AS seconds,
    length(props) + (props->>'$.k')::BIGINT AS input_tokens, (props->>'$.k')::BIGINT AS output_tokens
  FROM events)"""

_SUFFIX = "['.jpg', '.JPEG', '.svs', '.txt'][doc_id % 4 + 1]"

FILES = f"""files AS (
  SELECT doc_id, place || source || '/img_' || doc_id || {_SUFFIX} AS path,
    'img_' || doc_id AS img, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size
  FROM (SELECT doc_id, source, n_chars, unnest(CASE WHEN doc_id % 50 = 1
          THEN ['root/', 'root/copy/'] ELSE ['root/'] END) AS place
        FROM documents WHERE doc_id % 7 <> 0))"""

ORIGINALS = f"""originals AS (
  SELECT doc_id, 'img_' || doc_id AS name, n_chars, source,
    'pre/' || source || '/img_' || doc_id || {_SUFFIX} AS original
  FROM documents)"""

PAIRS = """pairs AS (
  SELECT a.conv_id || ':' || a.turn AS row_id, a.text AS ref, b.text AS hyp
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user')"""

CTES = {
    "qa": QA,
    "predictions": predictions(),
    "second": predictions("second", 5, 1),
    "judged": judged(),
    "regions": REGIONS,
    "slides": SLIDES,
    "scaled": SCALED,
    "image_rows": IMAGE_ROWS,
    "order_images": ORDER_IMAGES,
    "model_calls": CALLS,
    "files": FILES,
    "originals": ORIGINALS,
    "pairs": PAIRS,
}


def using(*names: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(CTES.get(name, name) for name in names) + "\n" + body
