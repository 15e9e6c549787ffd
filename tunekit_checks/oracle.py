"""DuckDB SQL for the registered queries, written from the rules rather than from the plans."""

from __future__ import annotations

from tunekit.operators import parsing as Parse
from tunekit.operators import prompts as P
from tunekit_checks.queries import LEXICON, SWAPS

NL = "chr(10)"
_RANGES = [(9, 13), (28, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233),
           (8239, 8239), (8287, 8287), (12288, 12288)]
WS_CHARS = "||".join(f"chr({c})" for a, b in _RANGES for c in range(a, b + 1))
WS = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _RANGES) + "]"
BLANK = rf"\n{WS}*\n"


def lit(text: str) -> str:
    """SQL literal of any text."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def ltrim(x: str) -> str:
    return f"ltrim({x}, {WS_CHARS})"


def fill(template: str, **values: str) -> str:
    """SQL expression of a template: values are SQL, the rest is literal."""
    from string import Formatter

    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(lit(text))
        if name is not None:
            parts.append(f"({values[name]})")
    return " || ".join(parts)


PARAS = f"replace(text, {NL}, {NL}||{NL})"
MD = f"'# Doc '||doc_id||{NL}||replace(replace(text, {NL}, {NL}||'## '), '. ', '.'||{NL})"
RUNS = (
    f"repeat({NL}, (doc_id % 3)::INT)||replace(text, {NL}, repeat({NL}, (doc_id % 4 + 2)::INT))"
)
LANGUAGE = "CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'ruby' END"
CODE = (
    f"'import x'||{NL}||replace(replace(text, {NL}, {NL}||CASE WHEN doc_id % 2 = 0 THEN 'def ' "
    f"ELSE 'module ' END), '. ', {NL}||'    ')"
)
SAFE = strip(r"""regexp_replace(text, '["''\\\x00-\x1f]', ' ', 'g')""")


def body(quote: str = '"') -> str:
    q = lit(quote)
    pairs = (("instruction", "source"), ("input", "lang"), ("output", SAFE))
    inner = "||', '||".join(f"{q}||'{k}'||{q}||': '||{q}||{v}||{q}" for k, v in pairs)
    return "'{'||" + inner + "||'}'"


NOISY = f"""CASE doc_id % 8
  WHEN 0 THEN {body()}
  WHEN 1 THEN '```json'||{NL}||{body()}||{NL}||'```'
  WHEN 2 THEN '```'||{NL}||{body()}||{NL}||'```'
  WHEN 3 THEN ' Here''s the JSON: '||{body()}
  WHEN 4 THEN 'Sure, here you go: '||{body()}||' Hope it helps.'
  WHEN 5 THEN 'Output: ['||{body()}||', '||{body()}||',]'
  WHEN 6 THEN {body("'")}
  ELSE 'not json at all '||lang END"""
INPUT = f"CASE WHEN doc_id % 7 = 0 THEN ' '||{NL}||chr(12288) ELSE lang END"
ENTITIES = (
    "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', chr(169)), "
    "'&middot;', chr(183)), '&amp;', '&')"
)


def windows(src: str, key: str, size: int, overlap: int) -> str:
    """CTE body: overlapping windows of column t of a relation."""
    step = size - overlap
    return f"""SELECT {key}, w AS idx, substring(t, w*{step}+1, {size}) AS content,
      w*{step} AS start_char, least(w*{step}+{size}, length(t)) AS end_char
      FROM (SELECT *, unnest(range(0, greatest(ceil((length(t)-{size})/{step}.0), 0)::BIGINT + 1)) AS w FROM {src})"""


def paragraphs(text: str) -> str:
    """CTEs ending in ``para(doc_id, idx, content, start_char, end_char)``."""
    return f"""base AS (SELECT doc_id, {text} AS t FROM documents),
    cut AS (SELECT doc_id, string_split_regex(t, '{BLANK}') ps, regexp_extract_all(t, '{BLANK}') ss FROM base),
    piece AS (SELECT doc_id, ss, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM cut),
    placed AS (SELECT doc_id, k, p, coalesce(sum(length(p) + coalesce(length(ss[k]), 0)) OVER
      (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS origin FROM piece),
    para AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, {strip('p')} AS content,
      (origin + length(p) - length({ltrim('p')}))::BIGINT AS start_char,
      (origin + length(p) - length({ltrim('p')}) + length({strip('p')}))::BIGINT AS end_char
      FROM placed WHERE {strip('p')} <> '')"""


def fitted(source: str, size: int, overlap: int, extra: str = "") -> str:
    """CTE ``fit``: pieces of ``source`` within size, longer ones cut into windows."""
    step = size - overlap
    return f"""fit0 AS (SELECT *, unnest(range(0, greatest(ceil((length(content)-{size})/{step}.0), 0)::BIGINT + 1)) AS w FROM {source}),
    fit AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, w) - 1 AS chunk_index,
      substring(content, w*{step}+1, {size}) AS content,
      CASE WHEN length(content) <= {size} THEN start_char ELSE start_char + w*{step} END AS start_char,
      CASE WHEN length(content) <= {size} THEN end_char ELSE start_char + least(w*{step}+{size}, length(content)) END AS end_char,
      CASE WHEN length(content) <= {size} THEN 'semantic' ELSE 'semantic_fixed' END AS strategy{extra} FROM fit0)"""


def merged(size: int) -> str:
    """CTEs ending in ``done``: greedy merge of ``fit``."""
    return f"""walk AS (
      SELECT doc_id, chunk_index, length(content) AS open_len, 0 AS grp FROM fit WHERE chunk_index = 0
      UNION ALL
      SELECT f.doc_id, f.chunk_index,
        CASE WHEN w.open_len + length(f.content) + 2 <= {size} THEN w.open_len + length(f.content) + 2 ELSE length(f.content) END,
        CASE WHEN w.open_len + length(f.content) + 2 <= {size} THEN w.grp ELSE w.grp + 1 END
      FROM walk w JOIN fit f ON f.doc_id = w.doc_id AND f.chunk_index = w.chunk_index + 1),
    glued AS (SELECT doc_id, grp, string_agg(content, {NL}||{NL} ORDER BY chunk_index) AS joined,
      min(start_char) AS start_char FROM fit JOIN walk USING (doc_id, chunk_index) GROUP BY doc_id, grp),
    done AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS chunk_index, {strip('joined')} AS content,
      start_char, start_char + length(joined) AS end_char, 'hybrid_semantic' AS strategy FROM glued WHERE {strip('joined')} <> '')"""


def md_sections(text: str = MD) -> str:
    """CTEs ending in ``sec(doc_id, idx, title, content, level, start_line, end_line)``."""
    return f"""ls AS (SELECT doc_id, unnest(string_split(t, {NL})) AS line, generate_subscripts(string_split(t, {NL}), 1) - 1 AS i
      FROM (SELECT doc_id, {text} AS t FROM documents)),
    hs AS (SELECT *, regexp_matches(line, '^{WS}*#{{1,6}}( |\\z)') AS h FROM ls),
    ns AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec_no FROM hs),
    gs AS (SELECT doc_id, sec_no, min(i) AS start_line, max(i) AS end_line, max(line) FILTER (h) AS head,
      count(*) FILTER (NOT h) AS below, string_agg(line, {NL} ORDER BY i) FILTER (NOT h) AS txt FROM ns GROUP BY ALL),
    ts AS (SELECT *, {strip(f"regexp_replace(head, '^{WS}*#{{1,6}}', '')")} AS title FROM gs),
    sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no) - 1 AS idx, title, coalesce({strip('txt')}, '') AS content,
      coalesce(length(regexp_extract(head, '^{WS}*(#{{1,6}})', 1)), 0) AS level, start_line, end_line
      FROM ts WHERE below > 0 OR title <> '')"""


def code_sections() -> str:
    """CTEs ending in ``sec``; line splits happen at definition lines only."""
    word = r"[\p{L}\p{N}\p{M}_]+"
    keyed = f"CASE WHEN {LANGUAGE} = 'python' THEN regexp_extract({strip('line')}, '^(def|class){WS}+{word}') ELSE regexp_extract({strip('line')}, '^(def|class|module){WS}+{word}') END"
    return f"""ls AS (SELECT doc_id, unnest(string_split(t, {NL})) AS line, generate_subscripts(string_split(t, {NL}), 1) - 1 AS i
      FROM (SELECT doc_id, {CODE} AS t FROM documents)),
    hs AS (SELECT *, {keyed} AS head FROM ls),
    ns AS (SELECT *, sum((head <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec_no FROM hs),
    sec AS (SELECT doc_id, sec_no, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no) - 1 AS idx,
      regexp_replace(max(head) FILTER (head <> ''), '{WS}+', ' ') AS title, string_agg(line, {NL} ORDER BY i) AS content,
      (sec_no > 0)::INT AS level, min(i) AS start_line, max(i) AS end_line FROM ns GROUP BY doc_id, sec_no)"""


def laid_out(size: int, overlap: int, text: str, shown: str, extra: str) -> str:
    """CTEs from ``sec`` to fitted chunks at ordinal offsets."""
    return f"""txt AS (SELECT *, {text} AS full_text FROM sec),
    pos AS (SELECT *, coalesce(sum(length(full_text) + 1) OVER (PARTITION BY doc_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM txt),
    pieces AS (SELECT doc_id, idx, title, level, {shown} AS content, start_char, start_char + length(full_text) AS end_char
      FROM pos WHERE {strip('full_text')} <> ''),
    {fitted('pieces', size, overlap, extra)}"""


def boundaries() -> str:
    text = f"({MD})||{NL}||{NL}||({PARAS})"

    def spans(name: str, pattern: str, pick: str) -> str:
        return f"""{name} AS (SELECT doc_id, {pick} AS b FROM (
          SELECT doc_id, k, length(ss[k]) AS sl, sum(length(ps[k]) + length(ss[k])) OVER (PARTITION BY doc_id ORDER BY k) AS e
          FROM (SELECT doc_id, string_split_regex(t, '{pattern}') ps, regexp_extract_all(t, '{pattern}') ss,
            unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS k FROM base)))"""

    return f"""WITH base AS (SELECT doc_id, {text} AS t FROM documents),
    {spans('blank', BLANK, 'e')}, {spans('head', rf'\n#{{1,6}}{WS}', 'e - sl + 1')},
    {spans('fence', r'\n```', 'e - sl + 1')},
    bs AS (SELECT DISTINCT doc_id, b FROM (FROM blank UNION ALL FROM head UNION ALL FROM fence)),
    tg AS (SELECT doc_id, length(t) // 2 AS target FROM base)
    SELECT tg.doc_id, count(b) AS n_boundaries, coalesce(sum(b), 0)::BIGINT AS sum_boundaries,
      coalesce(max(b) FILTER (b BETWEEN target - 100 AND target), min(b) FILTER (b BETWEEN target AND target + 100), target)::BIGINT AS nearest
    FROM tg LEFT JOIN bs USING (doc_id) GROUP BY tg.doc_id, target"""


def text_sections() -> str:
    return f"""WITH RECURSIVE ls AS (SELECT doc_id, unnest(string_split(t, {NL})) AS line, generate_subscripts(string_split(t, {NL}), 1) - 1 AS i
      FROM (SELECT doc_id, {RUNS} AS t FROM documents)),
    fl AS (SELECT *, {strip('line')} = '' AS blank FROM ls),
    st AS (SELECT doc_id, i, false AS flush, true AS has_lines FROM fl WHERE i = 0
      UNION ALL
      SELECT f.doc_id, f.i, f.blank AND s.has_lines, NOT (f.blank AND s.has_lines)
      FROM st s JOIN fl f ON f.doc_id = s.doc_id AND f.i = s.i + 1),
    gr AS (SELECT doc_id, i, line, flush, sum(flush::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM st JOIN fl USING (doc_id, i)),
    se AS (SELECT doc_id, g, string_agg(line, {NL} ORDER BY i) AS txt, min(i) AS start_line, max(i) AS end_line
      FROM gr WHERE NOT flush GROUP BY doc_id, g),
    ok AS (SELECT *, {strip('txt')} AS content FROM se WHERE {strip('txt')} <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section_index, NULL::VARCHAR AS title, content, 0 AS level, start_line, end_line FROM ok
    UNION ALL
    SELECT doc_id, 0, NULL::VARCHAR, '', 0, 0, max(i) FROM ls WHERE doc_id NOT IN (SELECT doc_id FROM ok) GROUP BY doc_id"""


def html_regex(x: str) -> str:
    for pattern, to in (
        (r"(?is)<script[^>]*>.*?</script>", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"(?i)<(br|p|div|h[1-6]|li|tr)[^>]*>", "\n"),
        (r"<[^>]+>", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', {NL if to else lit('')}, 'g')"
    x = ENTITIES.format(x=x)
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {NL}||{NL}, 'g')"
    return strip(x)


def html_tree(x: str) -> str:
    mark = "chr(57344)"
    for pattern in (
        r"(?s)<!--.*?-->",
        r"(?is)<script([ \t\n/][^>]*)?>.*?</script\s*>",
        r"(?is)<style([ \t\n/][^>]*)?>.*?</style\s*>",
        r"(?is)<head([ \t\n/][^>]*)?>.*?</head\s*>",
        r"(?s)<[a-zA-Z/!?][^>]*>",
    ):
        x = f"regexp_replace({x}, '{pattern}', {mark}, 'g')"
    nodes = f"list_transform(string_split({ENTITIES.format(x=x)}, {mark}), lambda n: {strip('n')})"
    joined = f"array_to_string(list_filter({nodes}, lambda n: n <> ''), {NL})"
    return strip(f"regexp_replace({joined}, '\\n{{3,}}', {NL}||{NL}, 'g')")


def augment_sql(target_null: str = "lang") -> str:
    """Rows with their augmentation prompt and the failure the stub model raises for it."""
    context = "CASE WHEN source IS NULL THEN 'text: '||text ELSE 'text: '||text||chr(10)||'source: '||source END"
    prompt = fill(P.AUGMENT_USER, context=context, target="'lang'", current=f"coalesce(lang, {lit(P.EMPTY_VALUE)})")
    return f"""rows AS (SELECT doc_id, text, CASE WHEN doc_id % 4 <> 0 THEN source END AS source,
      CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents),
    asked AS (SELECT *, {prompt} AS prompt FROM rows),
    tried AS (SELECT *, {FAILS.format(p='prompt')} AS error FROM asked)"""


FAILS = (
    "CASE length({p}) % 10 WHEN 0 THEN 'Connection refused' WHEN 1 THEN 'model m not found' "
    "WHEN 2 THEN 'Context length exceeded' END"
)
CONVERSATIONS = f"""turns AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN ' '||{NL} ELSE text END AS content FROM conversations)"""


def scored() -> str:
    """CTEs ending in ``sc``: window scores per checked field of the SFT entries."""
    hits = " OR ".join(f"contains(w, '{word}')" for word in LEXICON)
    return f"""entry AS (SELECT doc_id, source AS instruction, {INPUT} AS input, text AS output FROM documents),
    f AS (SELECT doc_id, 0 AS o, 'instruction' AS field, instruction AS t FROM entry
      UNION ALL SELECT doc_id, 1, 'input', input FROM entry UNION ALL SELECT doc_id, 2, 'output', output FROM entry),
    tk AS (SELECT *, string_split_regex({strip('t')}, '{WS}+') AS ts FROM f WHERE {strip('t')} <> ''),
    wd AS (SELECT *, unnest(range(0, greatest(ceil((len(ts) - 382) / 254.0), 0)::BIGINT + 1)) AS i FROM tk),
    wt AS (SELECT *, CASE WHEN len(ts) <= 382 THEN t ELSE array_to_string(ts[i*254+1 : i*254+382], ' ') END AS w FROM wd),
    sc AS (SELECT doc_id, o, field, any_value(t) AS t, sum(CASE WHEN {hits} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) / count(*) AS p, count(*) AS n
      FROM wt GROUP BY doc_id, o, field),
    ve AS (SELECT doc_id, bool_and(p >= 0.75) AS passed FROM sc GROUP BY doc_id)"""


QC_SCORES = f"""WITH {scored()} SELECT doc_id, field,
  CASE WHEN length(t) > 100 THEN substring(t, 1, 100)||'...' ELSE t END AS text_preview,
  CASE WHEN p > 0.5 THEN 'Taiwan Traditional' ELSE 'Mainland Traditional' END AS label,
  greatest(p, 1.0 - p) AS confidence, p AS accepted_probability, 1.0 - p AS rejected_probability, n AS num_windows, p >= 0.75 AS ok FROM sc"""
SOURCE_ROWS = "SELECT doc_id::VARCHAR AS doc_id, lang, source, text FROM documents"
FIXED = f"""WITH base AS (SELECT doc_id, text AS t FROM documents WHERE {strip('text')} <> ''),
  win AS ({windows('base', 'doc_id', 500, 50)})
  SELECT doc_id, idx AS chunk_index, content, start_char, end_char, 'fixed_size' AS strategy FROM win"""


def mixed() -> str:
    leaves = f"array_to_string(list_filter([source, text, lang], lambda x: {strip('x')} <> ''), {NL})"
    return f"""SELECT '/d/'||doc_id||['.md', '.txt', '.PY', '.json', '.xyz'][doc_id % 5 + 1] AS source_path,
      ['markdown', 'text', 'code', 'json', NULL][doc_id % 5 + 1] AS doc_type,
      CASE doc_id % 5 WHEN 3 THEN {leaves} WHEN 4 THEN NULL ELSE text END AS content, doc_id % 5 = 4 AS failed FROM documents
    UNION ALL SELECT '/p/'||page_id||'.html', 'html', {html_regex('html')}, false FROM pages"""


def page_name() -> str:
    base = r"regexp_replace(url, '[?#].*$|/$|\.html$', '', 'g')"
    return f"{base}||['.md', '.HTML', '.py', '.tar.gz', '', '.jsonl', '.txt', '.CSV'][page_id % 8 + 1]"


def case_of(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {column} = {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {whens} END"


def plan(topics: str, batch: int, extra: str = "") -> str:
    return f"""pl AS (SELECT topic, n, CASE WHEN n <= 3 THEN 1 ELSE {batch} END AS per FROM ({topics})),
    rq AS (SELECT topic, b + 1 AS batch_number, least(per, n - b * per)::BIGINT AS batch_size
      FROM (SELECT *, unnest(range(0, ceil(n / per)::BIGINT)) AS b FROM pl))"""


# Positions that Spark counts in 32 bits.
INT_COLUMNS = {
    "chunk_fixed": ("chunk_index",),
    "chunk_paragraphs": ("chunk_index",),
    "chunk_semantic": ("chunk_index",),
    "chunk_hybrid": ("chunk_index",),
    "chunk_markdown": ("chunk_index", "section_level"),
    "chunk_code": ("chunk_index",),
    "md_sections": ("section_index", "level", "start_line", "end_line"),
    "text_sections": ("section_index", "start_line", "end_line"),
    "code_sections": ("section_index", "start_line", "end_line"),
    "json_leaves": ("leaf_index",),
    "prompt_chunk": ("chunk_index",),
    "conversation_replies": ("idx",),
    "qc_windows": ("window_index",),
    "qc_subword_windows": ("window_index",),
    "qc_scores": ("num_windows",),
    "qc_batch_scorer": ("num_windows",),
    "doc_to_dataset": ("chunk_index",),
    "stream_documents": ("chunk_index",),
}


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["chunk_fixed"] = FIXED
    sql["chunk_paragraphs"] = f"WITH {paragraphs(PARAS)} SELECT doc_id, idx AS chunk_index, content, start_char, end_char FROM para"
    sql["chunk_semantic"] = f"WITH {paragraphs(PARAS)}, {fitted('para', 300, 30)} SELECT * FROM fit"
    sql["chunk_hybrid"] = f"WITH RECURSIVE {paragraphs(PARAS)}, {fitted('para', 300, 30)}, {merged(300)} SELECT * FROM done"
    heading = f"CASE WHEN title <> '' THEN CASE WHEN level > 0 THEN repeat('#', level)||' ' ELSE '' END||title||{NL}||{NL}||content ELSE content END"
    sql["chunk_markdown"] = f"""WITH {md_sections()},
      {laid_out(1000, 100, heading, strip('full_text'), ', title AS section_title, level AS section_level')}
      SELECT * FROM fit"""
    sql["chunk_code"] = f"""WITH {code_sections()},
      {laid_out(1000, 100, 'content', 'full_text', f', title AS definition, {LANGUAGE} AS language')}
      SELECT * FROM fit"""
    sql["boundaries_nearest"] = boundaries()
    cols = "doc_id, idx AS section_index, title, content, level, start_line, end_line"
    sql["md_sections"] = f"WITH {md_sections()} SELECT {cols} FROM sec"
    sql["text_sections"] = text_sections()
    sql["code_sections"] = f"WITH {code_sections()} SELECT {cols} FROM sec"
    sql["md_metadata"] = """SELECT doc_id, 'lang' AS key, lang||'2' AS value FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'source', 'x:'||source FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'title', 'Doc '||doc_id FROM documents"""
    sql["html_text_regex"] = f"SELECT page_id, {html_regex('html')} AS text FROM pages"
    sql["html_text_tree"] = f"SELECT page_id, {html_tree('html')} AS text FROM pages"
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    sql["html_metadata"] = f"""SELECT page_id,
      CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN {ENTITIES.format(x=strip(title))} END AS title,
      CASE WHEN page_id % 2 = 0 THEN url||' & more' END AS description FROM pages"""
    sql["json_leaves"] = f"""SELECT doc_id, idx - 1 AS leaf_index, leaf FROM (
      SELECT doc_id, unnest(l) AS leaf, generate_subscripts(l, 1) AS idx FROM (
        SELECT doc_id, list_filter([source, text, lang], lambda x: {strip('x')} <> '') AS l FROM documents))"""
    sql["json_leaves_events"] = """SELECT event_id, 0 AS leaf_index, event_type AS leaf FROM events
      UNION ALL SELECT event_id, 1, 'u'||user_id FROM events"""
    sql["json_metadata"] = """SELECT event_id, 'original_structure' AS key, CASE WHEN event_id % 3 = 0 THEN 'list' ELSE 'dict' END AS value FROM events
      UNION ALL SELECT event_id, 'title', event_type FROM events WHERE event_id % 3 <> 0
      UNION ALL SELECT event_id, 'name', 'u'||user_id FROM events WHERE event_id % 3 <> 0"""
    sql["page_assembly"] = f"""WITH ls AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS page FROM documents),
      pg AS (SELECT *, page % 7 = 0 AS failed, CASE WHEN (page - 1) % 5 = 4 THEN ' ' ELSE line END AS body FROM ls),
      sh AS (SELECT *, NOT failed AND {strip('body')} <> '' AS usable FROM pg)
      SELECT doc_id, coalesce(string_agg(CASE WHEN failed THEN '[Error extracting page '||page||': unreadable]' ELSE body END, {NL}||{NL} ORDER BY page) FILTER (failed OR usable), '') AS content,
        count(*)::VARCHAR AS page_count, greatest(count(*) FILTER (usable), 1) AS n_sections,
        coalesce(string_agg('Page '||page, ',' ORDER BY page) FILTER (usable), '') AS titles FROM sh GROUP BY doc_id"""
    sql["parse_documents"] = mixed()
    sql["text_decode"] = "SELECT doc_id, text FROM documents"

    prompt = fill(
        P.CHUNK_USER, count="'2'", content="content", hint=lit(P.ENTRY_HINTS["dpo"]),
        keys="'prompt, chosen, rejected'", guidance="''",
    )
    sql["prompt_chunk"] = f"""WITH base AS (SELECT doc_id, text AS t FROM documents WHERE {strip('text')} <> ''),
      win AS ({windows('base', 'doc_id', 2000, 200)})
      SELECT doc_id, idx AS chunk_index, {fill(P.CHUNK_SYSTEM, guidance="''")} AS system_prompt, {prompt} AS user_prompt FROM win"""
    sql["prompt_augment"] = f"""WITH {augment_sql()} SELECT doc_id, prompt AS user_prompt,
      {fill(P.AUGMENT_SYSTEM, target="'lang'", instruction="'Name the language.'", guidance=lit(P.LOCALES["zh-tw"]))} AS system_prompt FROM asked"""
    shape = "CASE WHEN batch_size > 1 THEN 'a JSON array of '||batch_size||' objects' ELSE 'one JSON object' END"
    sql["topic_prompts"] = f"""WITH {plan("SELECT source AS topic, count(*) AS n FROM documents GROUP BY source", 4)}
      SELECT *, {fill(P.TOPIC_SYSTEM, topic="topic", hint=lit(P.ENTRY_HINTS["pretrain"]), keys="'text'", shape=shape, guidance="''")} AS system_prompt,
      {fill(P.TOPIC_USER, topic="topic", number="batch_number", count="batch_size", kind="'text'", guidance="''")} AS user_prompt FROM rq"""
    sql["request_plan"] = f"WITH {plan('SELECT event_type||chr(47)||user_id AS topic, count(*) AS n FROM events GROUP BY 1', 5)} SELECT * FROM rq"
    sql["funnel_request_count"] = """SELECT source, target, floor(target * greatest(1.2::DOUBLE, least(3.0::DOUBLE, 1.0 / greatest(0.1::DOUBLE, least(1.0::DOUBLE, rate)))) + 0.5)::BIGINT AS requests
      FROM (SELECT source, count(*) AS target, avg(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source)"""
    sql["augment_column_model"] = f"WITH {augment_sql()} SELECT doc_id, text, source, md5(prompt) AS lang, NULL::VARCHAR AS error FROM asked"
    sql["augment_with_failures"] = f"WITH {augment_sql()} SELECT doc_id, text, source, CASE WHEN error IS NULL THEN md5(prompt) ELSE lang END AS lang, error FROM tried"
    sql["augment_summary"] = f"""WITH {augment_sql()} SELECT count(*) AS total_entries, count(*) - count(error) AS success_count, count(error) AS failure_count,
      (count(*) - count(error)) / count(*) * 100 AS success_rate FROM tried"""
    topic = fill(P.AUGMENT_USER, context="'text: '||text", target="'topic'", current=lit(P.EMPTY_VALUE))
    sql["augment_new_field"] = f"""WITH {augment_sql()}, nf AS (SELECT doc_id, text, source, lang, {topic} AS prompt FROM rows)
      SELECT doc_id, text, source, lang, CASE WHEN {FAILS.format(p='prompt')} IS NULL THEN md5(prompt) END AS topic, {FAILS.format(p='prompt')} AS error FROM nf"""
    sql["augment_preview"] = f"WITH {augment_sql()} SELECT doc_id, lang AS before, md5(prompt) AS after FROM asked ORDER BY doc_id LIMIT 5"
    sql["augment_resume"] = f"WITH {augment_sql()} SELECT doc_id, md5(prompt) AS lang, NULL::VARCHAR AS error FROM asked"
    sql["error_classes"] = f"""WITH {augment_sql()} SELECT CASE error WHEN 'Connection refused' THEN 'connection' WHEN 'model m not found' THEN 'model_not_found'
      ELSE 'context_length_exceeded' END AS error_class, count(*) AS n, min(error) AS sample FROM tried WHERE error IS NOT NULL GROUP BY 1"""
    sql["first_errors"] = f"WITH {augment_sql()} SELECT doc_id, error FROM tried WHERE error IS NOT NULL ORDER BY doc_id LIMIT 5"
    sql["batch_model_infer"] = """SELECT doc_id, CASE WHEN length(text) % 10 <> 0 THEN md5(text) END AS raw_content,
      CASE WHEN length(text) % 10 = 0 THEN 'Connection refused' END AS error FROM documents"""

    sql["response_clean"] = f"""SELECT doc_id, CASE doc_id % 8 WHEN 4 THEN 'Sure, here you go: '||{body()}||' Hope it helps.'
      WHEN 5 THEN '['||{body()}||', '||{body()}||',]' WHEN 6 THEN {body("'")} WHEN 7 THEN 'not json at all '||lang ELSE {body()} END AS cleaned FROM documents"""
    sql["response_repair"] = f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({NOISY}, ',{WS}*([}}\\]])', '\\1', 'g'),
      '''([^'']*)'':', '"\\1":', 'g'), ':{WS}*''([^'']*)''', ': "\\1"', 'g') AS repaired FROM documents"""
    entry = f"source AS instruction, lang AS input, {SAFE} AS output"
    sql["response_explode"] = f"""SELECT doc_id, unnest(CASE WHEN doc_id % 8 = 5 THEN [0, 1] ELSE [0] END) AS entry_index, {entry}
      FROM documents WHERE doc_id % 8 <> 7"""
    sql["response_strict"] = f"SELECT doc_id, 0 AS entry_index, {entry} FROM documents WHERE doc_id % 8 = 0"
    sql["conversation_replies"] = f"WITH {CONVERSATIONS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, content FROM turns"

    sql["validate_sft"] = f"""SELECT doc_id, doc_id % 7 <> 0 AND {strip('text')} <> '' AS valid,
      CASE WHEN doc_id % 7 = 0 THEN 'blank input' WHEN {strip('text')} = '' THEN 'blank output' END AS reject_reason FROM documents"""
    sql["validate_pretrain"] = f"""SELECT doc_id, doc_id % 11 <> 0 AND {strip('text')} <> '' AS valid,
      CASE WHEN doc_id % 11 = 0 OR {strip('text')} = '' THEN 'blank text' END AS reject_reason FROM documents"""
    sql["validate_dpo"] = f"""WITH p AS (SELECT a.doc_id, a.text AS chosen, CASE WHEN a.doc_id % 5 = 0 THEN ' '||a.text||{NL} ELSE b.text END AS rejected
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
      r AS (SELECT doc_id, CASE WHEN {strip('chosen')} = '' THEN 'blank chosen' WHEN coalesce({strip('rejected')}, '') = '' THEN 'blank rejected'
        WHEN {strip('chosen')} = {strip('rejected')} THEN 'chosen equals rejected' END AS reject_reason FROM p)
      SELECT doc_id, reject_reason IS NULL AS valid, reject_reason FROM r"""
    per_conv = f"bool_and({strip('content')} <> '') AS full_text, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, count(*) AS n_messages"
    sql["validate_conversation"] = f"WITH {CONVERSATIONS}, c AS (SELECT conv_id, {per_conv} FROM turns GROUP BY conv_id) SELECT conv_id, full_text AND u AND a AS valid, n_messages FROM c"
    sql["validate_conversation_entries"] = f"""WITH {CONVERSATIONS}, c AS (SELECT conv_id, {per_conv} FROM turns GROUP BY conv_id)
      SELECT conv_id, full_text AND u AND a AS valid, CASE WHEN NOT full_text THEN 'blank message' WHEN NOT u THEN 'no user message'
      WHEN NOT a THEN 'no assistant message' END AS reject_reason FROM c"""
    sql["conversation_entries"] = f"WITH {CONVERSATIONS} SELECT conv_id, to_json(list(struct_pack(role := role, content := content) ORDER BY turn))::VARCHAR AS entry FROM turns GROUP BY conv_id"
    sql["entry_round_trip"] = f"SELECT doc_id, source AS instruction, {INPUT} AS input, text AS output FROM documents"
    keys = "['instruction', 'text', 'conversations', 'prompt', 'other'][event_id % 5 + 1]"
    sql["infer_dataset_type"] = f"SELECT event_id, CASE {keys} WHEN 'instruction' THEN 'sft' WHEN 'text' THEN 'pretrain' WHEN 'conversations' THEN 'sft_conv' WHEN 'prompt' THEN 'dpo' END AS dataset_type FROM events"

    sql["qc_fields"] = f"WITH {scored()} SELECT doc_id, field, length(t) AS n_chars FROM tk"
    sql["qc_windows"] = f"""WITH tk AS (SELECT doc_id, text AS t, string_split_regex({strip('text')}, '{WS}+') AS ts FROM documents),
      wd AS (SELECT *, unnest(range(0, greatest(ceil((len(ts) - 382) / 254.0), 0)::BIGINT + 1)) AS i FROM tk)
      SELECT doc_id, i AS window_index, CASE WHEN len(ts) <= 382 THEN t ELSE array_to_string(ts[i*254+1 : i*254+382], ' ') END AS window_text FROM wd"""
    sql["qc_subword_windows"] = """WITH n AS (SELECT doc_id, text, (length(text) + 2) // 3 AS n FROM documents),
      wd AS (SELECT *, unnest(range(0, greatest(ceil((n - 382) / 254.0), 0)::BIGINT + 1)) AS i FROM n)
      SELECT doc_id, i AS window_index, CASE WHEN n <= 382 THEN text ELSE substr(text, (i * 254 * 3 + 1)::BIGINT, 382 * 3) END AS window_text FROM wd"""
    sql["qc_scores"] = QC_SCORES
    sql["qc_batch_scorer"] = QC_SCORES
    sql["qc_filter"] = f"WITH {scored()} SELECT entry.* FROM entry JOIN ve USING (doc_id) WHERE passed"
    sql["qc_failed_fields"] = f"WITH {scored()} SELECT doc_id, string_agg(field, ',' ORDER BY o) AS failed_fields FROM sc WHERE p < 0.75 GROUP BY doc_id"
    hits = " OR ".join(f"contains(w, '{word}')" for word in LEXICON)
    sql["qc_conversations"] = f"""WITH {CONVERSATIONS}, m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, content AS t,
        string_split_regex({strip('content')}, '{WS}+') AS ts FROM turns),
      wd AS (SELECT *, unnest(range(0, greatest(ceil((len(ts) - 382) / 254.0), 0)::BIGINT + 1)) AS i FROM m),
      wt AS (SELECT *, CASE WHEN len(ts) <= 382 THEN t ELSE array_to_string(ts[i*254+1 : i*254+382], ' ') END AS w FROM wd),
      sc AS (SELECT conv_id, idx, avg(CASE WHEN {hits} THEN 0 ELSE 1 END) AS p FROM wt GROUP BY conv_id, idx)
      SELECT conv_id, bool_and(p >= 0.75) AS qc_passed, coalesce(string_agg('conversations['||idx||'].content', ',' ORDER BY idx) FILTER (p < 0.75), '') AS failed_fields
      FROM sc GROUP BY conv_id"""
    sql["qc_stats"] = f"""WITH {scored()}, c AS (SELECT count(*) AS n, count(*) FILTER (passed) AS k FROM ve)
      SELECT n AS total_checked, k AS passed, n - k AS failed, n - k AS discarded, round(k / n * 100, 6) AS pass_rate,
      round((0.7::DOUBLE * (k / n) + 0.3::DOUBLE * 0.7::DOUBLE) * 100, 6) AS estimated_pass_rate FROM c"""
    sql["first_n_passing"] = f"WITH {scored()} SELECT doc_id, instruction, input FROM entry JOIN ve USING (doc_id) WHERE passed ORDER BY doc_id LIMIT 100"
    swapped = "text"
    for word, other in SWAPS.items():
        swapped = f"replace({swapped}, {lit(word)}, {lit(other)})"
    sql["lexicon_apply"] = f"SELECT doc_id, {swapped} AS text FROM documents"

    sql["field_discovery"] = "SELECT DISTINCT unnest(['id', event_type||'_'||(user_id % 3)]) AS field FROM events"
    sql["profile"] = f"""SELECT (SELECT count(*) FROM conversations) AS rows, 'conv_id,turn,role' AS fields,
      (SELECT string_agg(to_json(r)::VARCHAR, {NL}) FROM (SELECT struct_pack(conv_id := conv_id, turn := turn, role := role) AS r FROM conversations ORDER BY conv_id, turn LIMIT 3)) AS sample"""
    base_name = f"regexp_extract({page_name()}, '([^/]*)$', 1)"
    sql["glob_filter"] = f"""SELECT page_id, n GLOB '*.md' AS m_suffix, n GLOB '[0-4]*.[!mt]*' AS m_class, n GLOB '???.*' AS m_single
      FROM (SELECT page_id, {base_name} AS n FROM pages)"""
    fmts = {".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".txt": "sniff", ".data": "sniff"}
    sql["ext_filter"] = f"""WITH e AS (SELECT page_id, lower(regexp_extract({base_name}, '^.+(\\.[^.]+)$', 1)) AS ext FROM pages)
      SELECT page_id, ext, {case_of('ext', Parse.DOC_TYPES)} IS NOT NULL AS supported, {case_of('ext', Parse.DOC_TYPES)} AS doc_type,
      coalesce({case_of('ext', Parse.CODE_LANGUAGES)}, 'unknown') AS language, {case_of('ext', fmts)} AS fmt FROM e"""
    sql["format_sniff"] = "SELECT event_id, ['jsonl', 'csv', 'tsv', 'jsonl'][event_id % 4 + 1] AS fmt FROM events"
    sql["union_sources"] = """SELECT doc_id AS id, text, lang, NULL::VARCHAR AS url, 0 AS source_ordinal FROM documents
      UNION ALL SELECT item_id, text, NULL, NULL, 1 FROM benchmark UNION ALL SELECT page_id, NULL, NULL, url, 2 FROM pages"""
    sql["quarantine_bad_lines"] = """WITH l AS (SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'x'||props WHEN 2 THEN '['||props||']' WHEN 3 THEN 'null' ELSE '  '||props END AS line
        FROM events WHERE event_id % 10 <> 0),
      e AS (SELECT event_id, line, CASE WHEN NOT json_valid(line) THEN 'Invalid JSON' WHEN json_type(line) <> 'OBJECT' THEN 'Line is no JSON object but '||lower(json_type(line)) END AS error FROM l)
      SELECT event_id, error, CASE WHEN error IS NOT NULL THEN line END AS bad_line, CASE WHEN error IS NULL THEN json(line)::VARCHAR END AS value FROM e"""

    sql["validate_by_type"] = f"""SELECT doc_id, dataset_type, reject_reason IS NULL AS valid, reject_reason FROM (
      SELECT doc_id, ['sft', 'pretrain', 'dpo', 'other'][doc_id % 4 + 1] AS dataset_type, CASE doc_id % 4
        WHEN 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'blank input' WHEN {strip('text')} = '' THEN 'blank output' END
        WHEN 1 THEN CASE WHEN {strip('text')} = '' THEN 'blank text' END
        WHEN 2 THEN CASE WHEN {strip('text')} = '' THEN 'blank chosen' WHEN doc_id % 8 = 2 OR {strip('text')} = source THEN 'chosen equals rejected' END
        ELSE 'unknown dataset type' END AS reject_reason FROM documents)"""
    sql["jsonl_validity"] = """SELECT count(*) FILTER (event_id % 100 = 2) = 0 AS valid, count(*) FILTER (event_id % 100 <> 0) AS lines,
      count(*) FILTER (event_id % 100 = 2) AS bad_lines FROM events"""
    sql["html_sections"] = f"""SELECT page_id, t AS content, 0 AS level, 0 AS start_line, (length(t) - length(replace(t, {NL}, '')))::INTEGER AS end_line
      FROM (SELECT page_id, {html_regex('html')} AS t FROM pages)"""

    for fmt in ("jsonl", "json", "csv", "tsv", "parquet"):
        sql[f"roundtrip_{fmt}"] = SOURCE_ROWS
    sql["convert_chain"] = SOURCE_ROWS
    sql["csv_nested"] = f"""WITH {CONVERSATIONS} SELECT conv_id::VARCHAR AS conv_id, to_json(struct_pack(turn := turn, role := role))::VARCHAR AS meta,
      to_json([role, content])::VARCHAR AS pair FROM turns"""
    sql["mirror_describe"] = """SELECT 'default' AS config, CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split, count(*) AS rows,
      'doc_id: bigint, text: string, lang: string' AS fields FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 2"""

    sql["doc_to_dataset"] = f"""WITH RECURSIVE {paragraphs(PARAS)}, {fitted('para', 600, 60)}, {merged(600)}
      SELECT doc_id, chunk_index, 0 AS entry_index, 'Retell the passage.' AS instruction, content AS input, md5(content) AS output FROM done"""
    files = f"""base AS (SELECT doc_id, text AS t FROM documents WHERE doc_id % 50 <> 0 AND {strip('text')} <> ''),
      win AS ({windows('base', 'doc_id', 500, 0)}),
      ck AS (SELECT *, CASE WHEN length(content) < 20 THEN 'too short: '||idx END AS error FROM win),
      ag AS (SELECT doc_id, count(*) AS c, count(error) AS bad, string_agg(error, '|' ORDER BY idx) FILTER (error IS NOT NULL) AS errs FROM ck GROUP BY doc_id),
      fr AS (SELECT d.doc_id AS source_path, coalesce(c, 0) AS chunks_processed, coalesce(c - bad, 0) AS entries_generated, coalesce(bad, 1) AS error_count,
        CASE WHEN c IS NULL THEN 'No content to process' ELSE coalesce(errs, '') END AS errors, coalesce(bad, 1) = 0 AS success FROM documents d LEFT JOIN ag USING (doc_id))"""
    sql["file_results"] = f"WITH {files} SELECT * FROM fr"
    sql["batch_summary"] = f"""WITH {files} SELECT count(*) AS total_files, count(*) FILTER (success) AS successful_files, count(*) FILTER (NOT success) AS failed_files,
      sum(entries_generated)::BIGINT AS total_entries, count(*) FILTER (success) / count(*) * 100 AS success_rate FROM fr"""
    sql["generation_summary"] = """SELECT n AS success_count, 2000::BIGINT AS total_requested, n / 2000 * 100 AS success_rate
      FROM (SELECT sum(CASE doc_id % 8 WHEN 5 THEN 2 WHEN 7 THEN 0 ELSE 1 END)::BIGINT AS n FROM documents)"""
    sql["stream_documents"] = FIXED
    sql["jsonl_strict_lines"] = "SELECT doc_id, text FROM documents WHERE doc_id % 10 NOT IN (1, 2, 3, 4)"
    sql["json_shape"] = "SELECT doc_id, lang, text FROM documents WHERE doc_id % 8 NOT IN (3, 5)"
    sql["csv_ragged"] = """SELECT doc_id::VARCHAR AS doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN '["x,'||source||'"]' END AS more FROM documents"""
    sql["csv_header_union"] = """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang,
      CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents"""
    sql["csv_ranges"] = sql["json_ranges"] = sql["json_one_array"] = SOURCE_ROWS
    sql["first_passing_rounds"] = sql["first_n_passing"]
    sql["wave_progress"] = """SELECT 'digests' AS job, 4 AS waves, count(*) AS sent, count(*) FILTER (length(text) % 10 = 0) AS failed, true AS timed FROM documents"""
    sql["failure_budget"] = """SELECT doc_id, md5(lang||' '||text) AS reply, NULL::VARCHAR AS error, 'model_not_found 0' AS stopped FROM documents"""
    sql["roundtrip_nulls"] = """SELECT doc_id::VARCHAR AS doc_id, NULL::VARCHAR AS nothing, f.fmt FROM documents,
      (SELECT unnest(['jsonl', 'json', 'csv', 'tsv', 'parquet']) AS fmt) f"""
    sql["json_sections"] = f"""SELECT doc_id, text||{NL}||lang||{NL}||source AS content, 0::INTEGER AS level, 0::INTEGER AS start_line, 2::INTEGER AS end_line FROM documents"""
    sql["file_errors_all"] = f"""WITH base AS (SELECT doc_id, text AS t FROM documents), win AS ({windows('base', 'doc_id', 500, 0)})
      SELECT doc_id AS source_path, count(*) FILTER (idx % 2 = 0) AS error_count, string_agg('bad '||idx, '|' ORDER BY idx) FILTER (idx % 2 = 0) AS errors
      FROM win GROUP BY doc_id"""
    sql["qc_scorer_errors"] = "SELECT doc_id, source LIKE '%3' OR lang <> 'de' AS qc_passed FROM documents"
    sql["augment_dotted"] = "SELECT doc_id, lang AS source FROM documents"
    sql["profile_dotted"] = """SELECT count(*) AS rows, 'doc_id,meta.lang,text' AS fields, least(3, count(*))::INTEGER AS n,
      min_by(text, doc_id) AS first_text FROM documents"""
    texts = f"""SELECT (doc_id % 8 + 8 * ((doc_id // 8) % (SELECT greatest(1, ceil(count(*) / 8000.0))::BIGINT FROM documents)))::INTEGER AS g,
      string_agg(text, {NL} ORDER BY doc_id)||{NL} AS body FROM documents GROUP BY 1"""
    sql["document_scan"] = f"SELECT g, length(body)::INTEGER AS n, md5(body) AS digest FROM ({texts})"
    sql["document_list"] = f"SELECT g, 'text' AS doc_type, strlen(body) AS length FROM ({texts})"
    sql["document_file_stream"] = f"SELECT g, md5(body) AS digest FROM ({texts})"
    sql["paged_parser"] = f"""WITH ls AS (SELECT g, unnest(string_split(body, {NL})) AS line, generate_subscripts(string_split(body, {NL}), 1) AS page FROM ({texts}))
      SELECT g, page, 'lines' AS doc_type, CASE WHEN page % 7 <> 0 THEN md5(line) END AS digest, CASE WHEN page % 7 <> 0 THEN 'Page '||page END AS title,
        CASE WHEN page % 7 = 0 THEN 'unreadable' END AS error FROM ls WHERE page % 7 = 0 OR {strip('line')} <> ''"""
    sql["append_dataset_twice"] = SOURCE_ROWS
    sql["stream_row_cap"] = "SELECT least(500, count(*)) AS rows, least(500, count(DISTINCT doc_id)) AS ids, 0 AS strange FROM documents"
    sql["append_rows"] = sql["mirror_read"] = "SELECT doc_id::VARCHAR AS doc_id, lang, source, text FROM documents"
    sql["target_check"] = "SELECT unnest(['doc_id', 'even', 'odd']) AS field"
    sql["drop_null_rows"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0"
    languages = {
        "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c",
        "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "rb": "ruby",
    }
    known = ", ".join(f"('{e}', '{n}', {i})" for i, (e, n) in enumerate(languages.items()))
    sql["code_metadata"] = f"""WITH k(ext, lang, i) AS (VALUES {known}), d AS (SELECT doc_id, ext, k.lang FROM documents JOIN k ON doc_id % {len(languages)} = i)
      SELECT doc_id, 'code' AS doc_type, 'language' AS key, lang AS value FROM d UNION ALL SELECT doc_id, 'code', 'extension', '.'||ext FROM d
      UNION ALL SELECT doc_id, 'code', 'filename', 'f'||doc_id||'.'||ext FROM d"""
    titles = [
        ("  class Alpha:", "class Alpha"), ("const beta = async () => 1", "function beta"), ("function gamma() {", "function gamma"),
        ("public static void delta(", "void delta"), ("func (r *R) eps() {", "func eps"), ("pub struct Zeta {", "struct Zeta"),
        ("struct eta {", "struct eta"), ("class Theta {", "class Theta"), ("module Iota", "module Iota"),
    ]
    known = ", ".join(f"('{line}', '{title}', {i})" for i, (line, title) in enumerate(titles))
    sql["code_sections_all"] = f"""WITH k(line, title, i) AS (VALUES {known}), d AS (SELECT doc_id, source, line, title FROM documents JOIN k ON doc_id % 9 = i)
      SELECT doc_id, NULL::VARCHAR AS title, '#' AS content, 0::INTEGER AS start_line, 0::INTEGER AS end_line FROM d
      UNION ALL SELECT doc_id, title, line||{NL}||'# '||source, 1, 2 FROM d"""
    sql["entry_keys"] = """SELECT doc_id, 'pretrain' AS kind, CASE WHEN doc_id & 1 = 0 THEN lang||'0' ELSE '' END AS entry FROM documents
      UNION ALL SELECT doc_id, 'dpo', CASE WHEN doc_id & 7 = 0 THEN lang||'0|'||lang||'1|'||lang||'2' ELSE '' END FROM documents"""
    sql["infer_type_of_many"] = """SELECT doc_id, CASE WHEN doc_id & 8 = 0 THEN 'sft' WHEN doc_id & 4 = 0 THEN 'pretrain' WHEN doc_id & 2 = 0 THEN 'sft_conv'
      WHEN doc_id & 1 = 0 THEN 'dpo' END AS dataset_type FROM documents"""
    sql["roles"] = "SELECT conv_id, turn, turn % 3 = 0 AND role IN ('system', 'user', 'assistant') AS ok FROM conversations"
    sql["row_cap"] = "SELECT n::INTEGER AS n, least(n, (SELECT count(*) FROM documents)) AS rows FROM (SELECT unnest([1, 150, 100000, 100001]) AS n)"
    sql["without_nul"] = "SELECT doc_id, lang||source||text AS text FROM documents"
    sql["own_parser"] = """SELECT doc_id, 'log' AS doc_type, upper(source) AS content, 1::INTEGER AS n_sections, NULL::VARCHAR AS error FROM documents"""
    for name, columns in INT_COLUMNS.items():
        casts = ", ".join(f"{c}::INTEGER AS {c}" for c in columns)
        sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql[name]})"
    return sql
