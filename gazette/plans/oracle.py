"""The registered queries as SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

BLANKS = "chr(9) || chr(10) || chr(13) || ' '"

DOCS = r"""docs as (
  select doc_id, source, lang, text, split_part(text, chr(10), 1) as title,
         'https://news.example/a/' || doc_id as link,
         substr(source, 4)::int as feed_ord
  from documents)"""

LEDGER = DOCS + r""", ledger as (
  select doc_id as ingest_ord, link as url, title, source,
         case when doc_id % 11 <> 0 then timestamp '2024-01-01' + to_hours(((doc_id * 37) % 1000)::int) end as published_date,
         case when doc_id % 5 <> 0 then 'p' || doc_id end as page_id
  from docs)"""

CHOSEN = DOCS + r""", ranked as (
  select *, row_number() over (partition by source order by doc_id) as rk from docs),
chosen as (
  select * from ranked where rk <= 20 and feed_ord < 18
    and doc_id not in (select doc_id from labels))"""

ISO = "'%Y-%m-%dT%H:%M:%S'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def words(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    )


def cleaned(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for first, last in [
        ("Ce contenu est bloqué", "Gérer mes choix"),
        ("Les informations recueillies sont destinées", "politique Cookies"),
        ("En poursuivant votre navigation", "cookies"),
        ("Vous gardez la possibilité", "tout moment"),
    ]:
        out = f"regexp_replace({out}, '{first}.*?{last}', '', 'gs')"
    return collapse(out)


BANNERED = (
    "'<div class=\"x\">' || text || '</div>Ce contenu est bloqué' || chr(10) || 'par ' || source"
    " || ' Gérer mes choix<p>' || lang || '</p> Vous gardez la possibilité de' || chr(13) || chr(10)"
    " || 'changer à tout moment ' || chr(9) || '. En poursuivant votre navigation'"
)

SNIPPET = (
    "'<p>' || source || '<img class=\"x\" src=\"https://h/' || doc_id || '-LOGO.png\">'"
    " || case when doc_id % 3 = 0 then '' else '<img alt=\"\" src=''https://h/' || doc_id || '.jpg''>' end"
    " || '<img src=\"https://h/Icons/' || doc_id || '.gif\"></p>'"
)

TAILS = (
    "(['/a.jpg', '/LOGO.png', '/Site-Icon.PNG', '/x-min.png', '/pic32x32.gif', '/v.SVG', '/v.svg.jpg',"
    " '/mybrand/a.jpg', '/f.ico', ''])[page_id % 10 + 1]"
)
SITE_IMAGES = (
    "(['https://www.developpez.com/public/images/logo.png', 'https://www.developpez.com/images/logos/a.png',"
    " 'https://www.developpez.com/i/a.png', 'https://h/Banner.jpg', 'https://h/banner.jpg', ''])[page_id % 6 + 1]"
)


def feed_image_ok(x: str) -> str:
    bad = ["logo", "favicon", "fzn", "header", "footer", "icon", "banner", "-min.png", "brand",
           "16x16", "32x32", "64x64"]
    tests = " or ".join(f"contains(lower({x}), '{b}')" for b in bad)
    return f"({x} <> '' and not ({tests} or lower({x}) like '%.ico' or lower({x}) like '%.svg'))"


def page_image_ok(x: str) -> str:
    bad = ["logo", "favicon", "fzn", "header", "footer", "icon", "banner", "-min.png", "brand"]
    tests = " or ".join(f"contains({x}, '{b}')" for b in bad)
    return (
        f"case when {x} = '' then false"
        f" when contains({x}, 'developpez.com') and contains({x}, '/public/images/') then true"
        f" when contains({x}, 'developpez.com') and contains({x}, '/images/logos/') then false"
        f" else not ({tests}) end"
    )


def entity_decoded(x: str) -> str:
    for name, char in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{char}')"
    return x


def article_text(html: str) -> str:
    inner = f"regexp_extract({html}, '<article>(.*)</article>', 1, 's')"
    spaced = f"regexp_replace({inner}, '<[^>]+>', ' ', 'g')"
    return collapse(entity_decoded(spaced))


def chunk_ctes(table: str, limit: int) -> str:
    """Chunks of ``table`` (doc_id, text) by taking the longest fitting prefix again and again."""
    return f"""norm as (select doc_id, {collapse('text')} as rem from {table}),
cut as (
  select doc_id, -1 as pos, null::varchar as chunk, rem,
         case when length(split_part(rem, ' ', 1)) >= {limit} then 1 else 0 end as shift
  from norm where rem <> ''
  union all
  select doc_id, pos + 1, ck, substr(rem, length(ck) + 2), shift from (
    select *, case
      when length(rem) < {limit} then rem
      when contains(substr(rem, 1, {limit}), ' ')
        then substr(rem, 1, {limit} - length(regexp_extract(substr(rem, 1, {limit}), '[^ ]*$')) - 1)
      else split_part(rem, ' ', 1) end as ck
    from cut where rem <> '')),
chunks as (
  select doc_id, pos + shift as pos, chunk from cut where pos >= 0
  union all
  select doc_id, 0, '' from cut where pos = -1 and shift = 1)"""


def capped_ctes(table: str) -> str:
    return chunk_ctes(table, 1800) + """,
capped as (
  select doc_id, pos, case when pos = 9 and n > 10 then chunk || '... (contenu tronqué)' else chunk end as chunk
  from (select *, count(*) over (partition by doc_id) as n from chunks) where pos < 10)"""


RAW = r"""raw as (
  select doc_id, toxic = 1 as is_double, quality = 0 as is_commercial,
    case when doc_id % 5 = 0 then null else (doc_id % 13)::double end as score,
    'résumé ' || doc_id as summary,
    case when doc_id % 3 = 0 then 'tag' else 'Tag' end || case when doc_id % 4 = 0 then '|Autre' else '' end as tags,
    case when doc_id % 7 = 0 then 'plain answer ' || doc_id when doc_id % 13 = 0 then '[1, 2]' end as text_answer
  from labels)"""

# payload after defaults, per labelled document
FILLED = RAW + r""", filled as (
  select doc_id, text_answer,
    case when text_answer is null then is_double else false end as is_double,
    case when text_answer is null then is_commercial else false end as is_commercial,
    case when text_answer is null then coalesce(score, 0.0) else 0.0 end as score,
    case when text_answer is null then summary else text_answer end as summary,
    case when text_answer is null then tags else '' end as tags
  from raw)"""


def title_pairs(table: str) -> str:
    """CTEs ending in ``best`` (id, match_id, similarity) over ``table`` (id, title)."""
    return f"""tw as (select id, list_distinct({words('title')}) as w from {table}),
tok as (select id, len(w) as n, unnest(w) as t from tw),
pairs as (select a.id, b.id as other, count(*)::double as s, any_value(a.n) as na, any_value(b.n) as nb
  from tok a join tok b on a.t = b.t and b.id < a.id group by a.id, b.id),
best as (select id, min(other) as match_id, arg_min(s / (na + nb - s), other) as similarity
  from pairs where s / (na + nb - s) >= 0.7 group by id)"""


def tfidf_ctes(table: str) -> str:
    """CTEs ``lead`` (id, summary) and ``toptag`` (id, tag) over ``table`` (id, text)."""
    return f"""sl as (
  select id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s, ' ')), lambda s: s <> '') as ss
  from {table}),
sent as (select id, unnest(range(len(ss))) as pos, unnest(ss) as sentence from sl),
sterm as (select id, pos, unnest({words('sentence')}) as term from sent),
dterm as (select id, unnest({words('text')}) as term from {table}),
total as (select count(*)::double as n from {table}),
idf as (select term, round(ln(((select n from total) + 1) / (count(distinct id) + 1)::double) * 1000)::bigint as idf from dterm group by term),
sscore as (select id, pos, sum(idf) as score from sterm join idf using (term) group by id, pos),
srank as (select *, row_number() over (partition by id order by score desc, pos) as rn from sscore),
lead as (select id, string_agg(sentence, ' ' order by pos) as summary from srank join sent using (id, pos) where rn <= 3 group by id),
tscore as (select id, term, sum(idf) as score from dterm join idf using (term) group by id, term),
trank as (select *, row_number() over (partition by id order by score desc, term) as rn from tscore),
toptag as (select id, upper(substr(term, 1, 1)) || substr(term, 2) as tag from trank where rn = 1)"""


COMMERCIAL = [
    ("promotion", r"(?:^|[^\p{L}])(?:promo|promotion|offre|soldes|réduction)s?(?:[^\p{L}]|$)"),
    ("price", r"[€$£%]"),
    ("mention", r"(?:^|[^\p{L}])(?:sponsorisé|partenariat|publicité|achat|offer|discount|license)s?(?:[^\p{L}]|$)"),
    ("time", r"(?:^|[^\p{L}])(?:jusqu''au|dernière chance|aujourd''hui seulement|limited time|durée limitée)(?:[^\p{L}]|$)"),
    ("subscription", r"(?:^|[^\p{L}])(?:vpn|abonnement|subscribe|subscription)s?(?:[^\p{L}]|$)"),
]


def commercial(x: str) -> str:
    tests = ", ".join(
        f"case when regexp_matches(lower({x}), '{p}') then '{name}' end" for name, p in COMMERCIAL
    )
    return f"list_filter([{tests}], lambda h: h is not null)"


HISTORY = r"""hist as (
  select string_agg(n || '. ' || title, chr(10) order by n) as history from (
    select row_number() over (order by doc_id) as n, title from (
      select doc_id, title from docs order by doc_id desc limit 400)))"""

PROMPT = (
    "'Analyser cet article d''actualité.' || chr(10) || 'TITRE: ' || title || chr(10) || 'CONTENU: '"
    " || substr(text, 1, 1500) || chr(10) || chr(10) || 'Articles précédents :' || chr(10) || history"
    " || chr(10) || chr(10) || 'Indiquer s''il traite du même sujet principal qu''un article précédent, s''il est"
    " commercial, son importance de 0.0 à 10.0, un résumé factuel et un tag.' || chr(10)"
    " || 'Répondre en JSON : isDouble, similarArticle, similarityReason, isCommercial,"
    " significanceScore, summary, tags.'"
)


DELIVERED = DOCS + r""", delivered as (
  select source, link as url, quality = 0 as dbl, toxic = 1 as com, (doc_id % 11)::double as score,
         upper(substr(lang, 1, 1)) || substr(lang, 2) as tag
  from docs join labels using (doc_id))"""

EVENT_LINK = "'https://news.example/e/' || event_id"

ORACLES: dict[str, str] = {
    "feed_first_k": f"""with {DOCS}, r as (
      select *, row_number() over (partition by source order by doc_id) as feed_rank from docs)
      select feed_ord, 'Feed ' || feed_ord as feed_name, feed_rank, link, title from r
      where feed_rank <= 3 and feed_ord < 18""",
    "feed_counts": """with reg as (select range as n from range(18) union all select 99),
      c as (select source, count(*) as found from documents group by source)
      select 'src' || n as feed_url, 'Feed ' || n as feed_name, coalesce(found, 0) as found,
             least(coalesce(found, 0), 20) as after_limit, found is null as is_empty
      from reg left join c on c.source = 'src' || n""",
    "batch_dedup": f"""with {DOCS}, r as (
      select *, row_number() over (partition by md5(text) order by feed_ord, doc_id) as rn from docs)
      select 'https://news.example/t/' || md5(text) as link, source as feed_url, feed_ord, doc_id as pos
      from r where rn = 1""",
    "new_articles": f"""with {CHOSEN}
      select link, 'Feed ' || feed_ord as feed_name, translate({cleaned('text')}, '"«»', '''''''') as content
      from chosen""",
    "already_processed": f"""with {DOCS}, r as (
      select *, row_number() over (partition by source order by doc_id) as rk from docs)
      select link, 'Feed ' || feed_ord as feed_name, title from r
      where rk <= 20 and feed_ord < 18 and doc_id in (select doc_id from labels)""",
    "rss_entries": f"""with {DOCS}
      select source as feed_url, 0 as pos, trim(title, {BLANKS}) as title, link, trim(text, {BLANKS}) as summary,
             '-' as content, strftime(timestamp '2024-01-01' + to_minutes(doc_id), {ISO}) as published,
             'https://h/' || doc_id || '.jpg' as image_url, '-' as media
      from docs
      union all
      select source, 1, 'second', link || '/2', 'd' || doc_id, 'c', '2024-02-03T03:05:06', '-', 'https://h/m.jpg'
      from docs""",
    "entry_date": f"""select event_id, case when event_id % 6 = 5 then 'none' else strftime(ts, {ISO}) end as published
      from events""",
    "enclosure_image": """select doc_id, case
        when doc_id % 4 = 0 then 'https://h/last/' || source
        when doc_id % 3 = 0 then 'https://h/ref/' || doc_id
        else 'https://h/' || doc_id || '.png' end as image_url from documents""",
    "snippet_image": f"""select doc_id, list_filter(regexp_extract_all(
        {SNIPPET} || text || '<img src="https://h/' || lang || '/end.jpg">',
        '<img[^>]+src=[''"](https?://[^''"]+)[''"]', 1), lambda u: {feed_image_ok('u')})[1] as image_url
      from documents""",
    "image_url_valid_feed": f"""select page_id, {feed_image_ok('(url || ' + TAILS + ')')} as built_ok,
        {feed_image_ok('url')} as url_ok from pages""",
    "image_url_valid_page": f"""select page_id, {page_image_ok(SITE_IMAGES)} as site_ok,
        {page_image_ok('(url || ' + TAILS + ')')} as built_ok from pages""",
    "domain_route": """select page_id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) as host,
        ([true, false, true, true, false, false, false])[page_id % 7 + 1] as scrape from pages""",
    "image_resolve": f"""with {DOCS}, x as (
      select docs.*, quality, toxic,
        case when doc_id % 2 = 0 then 'https://clubic.com/' || doc_id else link end as lnk
      from docs left join labels using (doc_id)),
      y as (select *, coalesce(
        case when doc_id % 4 = 0 and doc_id % 3 <> 0 then 'https://h/' || doc_id || '.jpg' end,
        case when doc_id % 7 = 0 then 'https://h/c/' || doc_id || '.jpg' end,
        case when doc_id % 5 = 0 then 'https://h/m/' || doc_id || '.jpg' end,
        case when toxic = 1 then 'https://cache/' || doc_id end,
        case when doc_id % 2 = 0 and quality = 1 then 'https://scraped/' || doc_id || '/a.png' end) as img
      from x)
      select lnk as link, title, coalesce(case when img like 'https://cache/%' and source in ('src1', 'src2', 'src3')
        then img || '/hosted' else img end, 'none') as image_url from y""",
    "image_override": f"""with {DOCS}, e as (
      select 'www.jeuxvideo.com/' || md5(title) as l, doc_id as e_id from docs where doc_id % 2 = 0 and doc_id % 4 <> 1),
      f as (select l, min(e_id) as e_id from e group by l)
      select doc_id, case when doc_id % 3 = 0 and e_id is not null then 'https://h/enclosure/' || e_id
        else 'https://h/page/' || doc_id end as image_url
      from docs left join f on f.l = 'www.jeuxvideo.com/' || md5(title)""",
    "article_content": f"""select page_id, 'https://news.example/a/' || page_id as link, {article_text('html')} as content from pages
      union all select page_id, 'https://failed.example/' || page_id, 'summary of ' || url from pages where page_id % 10 = 0""",
    "main_image": """select 'https://news.example/a/' || page_id as url, case page_id % 6
        when 0 then 'https://h/og' || page_id || '.jpg'
        when 1 then 'https://h/tw' || page_id || '.jpg'
        when 2 then 'https://h/in-logo' || page_id || '.jpg'
        when 3 then '/body' || page_id || '.jpg'
        when 4 then '/thumb' || page_id || '.jpg'
        else 'none' end as image_url from pages""",
    "clean_content": f"""select 'd' || doc_id as key, {cleaned(BANNERED)} as content from documents
      union all select 'p' || page_id, {cleaned('html')} from pages""",
    "clean_quotes": """select doc_id, '''' || ' ' || lang || ' '' ''' ||
        replace(replace(replace(text, '"', ''''), '«', ''''), '»', '''') || '“' as content from documents""",
    "unescape_text": f"""select page_id, {entity_decoded('html')} || ' ’''été' || 'œ' || '¬it;&unknown;€' || chr(65533)
        || chr((161 + page_id % 90)::int) as content from pages""",
    "title_clean": f"""with {DOCS} select doc_id, regexp_replace(
        case when doc_id % 3 = 0 then lang else '' end || 'Actualité : ' || title || ' Actualité : ' || source,
        'Actualité : ', '') as title from docs""",
    "truncate_words": """with h as (select doc_id, text, substr(text, 1, 197) as head from documents)
      select doc_id, case when length(text) <= 200 then text
        when contains(head, ' ') then substr(head, 1, length(head) - length(regexp_extract(head, '[^ ]*$', 0, 's')) - 1) || '...'
        else head || '...' end as content from h""",
    "chunk_words": f"""with recursive {chunk_ctes('documents', 500)} select doc_id, pos, chunk from chunks""",
    "chunk_capped": f"""with recursive {capped_ctes('documents')} select doc_id, pos, chunk from capped""",
    "topic_id": f"""with {DOCS} select doc_id, md5(title || ' ' || text) as topic_id from docs""",
    "topic_groups": f"""with {DOCS} select md5(title || ' ' || text) as topic_id, min(doc_id) as first_id,
        count(*) as articles from docs group by 1 having count(*) > 1""",
    "payload_parse": f"""with {RAW}
      select doc_id, text_answer is null as parse_ok,
        case when text_answer is null then is_double::varchar else '-' end as is_double,
        case when text_answer is null then summary else '-' end as summary,
        case when text_answer is null then tags else '-' end as tags,
        text_answer is not null as ledger_empty from raw""",
    "payload_defaults": f"""with {FILLED} select doc_id, is_double, is_commercial, score, summary, tags from filled""",
    "payload_validate": f"""with {RAW}
      select doc_id, case when text_answer is not null then 'unparsed|score_missing|summary_missing|tag_count'
        else array_to_string(list_filter([
          case when score is null then 'score_missing' end,
          case when score > 10 then 'score_range' end,
          case when contains(tags, '|') then 'tag_count' end,
          case when tags like 'tag%' then 'tag_capital' end], lambda p: p is not null), '|') end as problems
      from raw""",
    "page_record": f"""with recursive {FILLED}, {DOCS},
      prep as (select doc_id, trim(text, {BLANKS}) as text from documents),
      {capped_ctes('prep')},
      ck as (select doc_id, count(*) as chunks, md5(string_agg(chunk, '|' order by pos)) as content_md5 from capped group by doc_id)
      select link, trim({entity_decoded('title')}, ' ') as title, link as url, source as flux,
        case when doc_id % 11 = 0 then '-' else strftime(timestamp '2024-01-01' + to_hours(((doc_id * 37) % 1000)::int), {ISO}) end as date,
        coalesce(chunks, 0) as chunks, coalesce(content_md5, md5('')) as content_md5,
        coalesce(f.is_commercial, false) as commercial, coalesce(f.score, 0.0) as score,
        coalesce(f.summary, '') as summary, coalesce(f.tags, '') as tags, coalesce(f.is_double, false) as double,
        case when doc_id % 3 = 0 then 'https://h/' || doc_id || '.jpg' else '-' end as image,
        case when doc_id % 3 = 0 then 'https://h/' || doc_id || '.jpg' else '-' end as cover
      from docs left join filled f using (doc_id) left join ck using (doc_id)""",
    "page_listing": """select case when page_id % 17 = 0 then '-' else 'r' || page_id end as page_id,
        case when page_id % 11 = 0 then '-' else url end as url,
        case when page_id % 13 = 0 then 'Sans titre' else 'Page ' || page_id end as title from pages""",
    "ledger_upgrade": f"""with {DOCS}
      select link as url, '-' as title, '-' as source, '-' as published, '-' as page_id from docs where doc_id % 4 = 0
      union all select link || '/old', '-', '-', '-', '-' from docs where doc_id % 4 = 0
      union all select link, title, '-', '2024-01-02T03:04:05', 'n' || doc_id from docs where doc_id % 4 = 1
      union all select link, '-', source, '-', '-' from docs where doc_id % 4 = 2""",
    "ledger_append": f"""with {DOCS}, {RAW}, x as (
      select docs.*, raw.summary, raw.doc_id is not null and text_answer is null as ok,
        doc_id % 11 <> 0 as dated,
        case when doc_id % 2 = 0 then '-' when doc_id % 3 = 0 then 'https://h/' || doc_id || '.jpg' else 'relative.jpg' end as img
      from docs left join raw using (doc_id) where doc_id % 6 <> 0)
      select link as url, translate('« ' || title, '"«»', '''''''') as title,
        translate({cleaned(BANNERED)}, '"«»', '''''''') as content,
        case when ok then summary else '-' end as summary,
        case when dated then strftime(timestamp '2024-01-01' + to_hours(((doc_id * 37) % 1000)::int), {ISO}) else '-' end as date,
        img as image_url, source, '2024-03-01T06:00:00' as processed_date,
        case when doc_id % 5 = 0 then '-' else 'n' || doc_id end as page_id,
        6 + (case when dated then 1 else 0 end) + (case when img <> '-' then 1 else 0 end)
          + (case when doc_id % 5 <> 0 then 1 else 0 end) as json_keys
      from x""",
    "interaction_log": """with p as (select * from conversations where role = 'user'),
      a as (select * from conversations where role = 'assistant')
      select p.conv_id, p.turn, '2024-03-01' as log_date, length(p.text) as prompt_chars,
        coalesce(length(a.text), 0) as response_chars,
        chr(10) || '=== NOUVELLE INTERACTION ===' || chr(10) || 'PROMPT:' || chr(10) || p.text || chr(10) || chr(10)
          || 'RÉPONSE:' || chr(10) || coalesce(a.text, '') || chr(10) || chr(10) || repeat('=', 50) || chr(10) as entry
      from p left join a on a.conv_id = p.conv_id and a.turn = p.turn + 1""",
    "ledger_retention": f"""with {LEDGER}, r as (
      select *, row_number() over (order by published_date asc nulls first, ingest_ord) as rn from ledger)
      select url, ingest_ord, coalesce(strftime(published_date, {ISO}), '-') as date from r
      where rn > 100 or (select count(*) from ledger) <= 400""",
    "archive_set": f"""with {LEDGER}, r as (
      select *, row_number() over (order by published_date asc nulls first, ingest_ord) as rn from ledger)
      select page_id, url, title, true as archived from r
      where rn <= 100 and page_id is not null and (select count(*) from ledger) > 100""",
    "retention_report": f"""with {LEDGER}, r as (
      select *, row_number() over (order by published_date asc nulls first, ingest_ord) as rn, count(*) over () as n from ledger)
      select any_value(n) as size_before, count(*) filter (rn <= 100 and n > 400) as removed,
        any_value(n) - count(*) filter (rn <= 100 and n > 400) as size_after,
        count(*) filter (rn <= 100 and n > 400 and page_id is not null) as to_archive from r""",
    "ledger_remove": f"""with {LEDGER} select url, source from ledger
      where ingest_ord not in (select doc_id from labels where doc_id % 10 <> 0)""",
    "purge_report": """with o as (
      select page_id, page_id % 17 <> 0 as valid, page_id % 17 <> 0 and page_id % 10 <> 7 as archived,
             case when page_id % 11 <> 0 then url end as u from pages),
      l as (select case when page_id % 2 = 0 then url else url || '?x' end as u from pages)
      select count(*) as total_pages, count(*) filter (archived) as archived_pages,
        count(*) filter (archived and u is not null) as archived_with_url,
        count(*) filter (not valid) as pages_without_id, count(*) filter (not archived) as errors,
        (select count(*) from l where u in (select u from o where archived and u is not null)) as ledger_removed,
        (select count(distinct ts::date) from events) as logs_removed
      from o""",
    "similar_titles": f"""with {DOCS}, a as (select doc_id as id, title from docs), {title_pairs('a')}
      select id, match_id, round(similarity, 6) as similarity from best""",
    "duplicate_flag": f"""with {DOCS}, a as (select doc_id as id, title from docs), {title_pairs('a')}
      select a.id, match_id is not null as is_double, coalesce(o.title, '-') as similar_article,
        case when match_id is null then '-' else array_to_string(list_sort(list_intersect(x.w, y.w)), ' ') end as similarity_reason
      from a left join best using (id) left join a o on o.id = match_id
        left join tw x on x.id = a.id left join tw y on y.id = match_id""",
    "near_dup_content": f"""with d as (select doc_id as id, {words('text')} as w from documents),
      g as (select id, case when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as gs
        from d where len(w) > 0),
      e as (select id, len(gs) as n, unnest(gs) as x from g),
      j as (select a.id, b.id as other, count(*)::double as i, any_value(a.n) as nx, any_value(b.n) as ny
        from e a join e b on a.x = b.x and b.id < a.id group by a.id, b.id)
      select id, min(other) as match_id, round(arg_min(i / (nx + ny - i), other), 6) as similarity
      from j where i / (nx + ny - i) >= 0.7 group by id""",
    "duplicate_evidence": f"""with {DOCS}, held as (select distinct doc_id from labels),
      tw as (select doc_id as id, list_distinct({words('title')}) as w from docs),
      tok as (select id, len(w) as n, unnest(w) as x from tw),
      tp as (select a.id, b.id as other, count(*)::double as i, any_value(a.n) as nx, any_value(b.n) as ny
        from tok a join tok b on a.x = b.x join held on held.doc_id = b.id group by a.id, b.id),
      t as (select id, min(other) as other, arg_min(i / (nx + ny - i), other) as t from tp where i / (nx + ny - i) >= 0.7 group by id),
      d as (select doc_id as id, {words('text')} as w from documents),
      g as (select id, case when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as gs
        from d where len(w) > 0),
      e as (select id, len(gs) as n, unnest(gs) as x from g),
      cp as (select a.id, b.id as other, count(*)::double as i, any_value(a.n) as nx, any_value(b.n) as ny
        from e a join e b on a.x = b.x join held on held.doc_id = b.id group by a.id, b.id),
      c as (select id, min(other) as other, arg_min(i / (nx + ny - i), other) as c from cp where i / (nx + ny - i) >= 0.7 group by id),
      both_kinds as (select id, other, coalesce(t, 0) as t, coalesce(c, 0) as c from t full join c using (id, other)),
      best as (select *, 1 - (1 - t) * (1 - c) as s,
        row_number() over (partition by id order by round(1 - (1 - t) * (1 - c), 9) desc, other) as rn from both_kinds)
      select id, other as match_id, round(t, 6) as title_similarity, round(c, 6) as content_similarity, round(s, 6) as similarity
      from best where rn = 1""",
    "embedding_neighbors": """with c as (
      select a.vec_id as id, b.vec_id as other,
        list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c
      from embeddings a join embeddings b on b.vec_id < a.vec_id)
      select id, min(other) as match_id, round(arg_min(c, other), 6) as similarity from c where c >= 0.35 group by id""",
    "commercial_flag": f"""with {DOCS}, x as (select doc_id, {commercial(
        "(title || ' ' || text || case when doc_id % 4 = 0 then ' Promotion : 20 € jusqu''au 3 mai' else '' end"
        " || case when doc_id % 6 = 0 then ' VPN' else '' end)")} as hits from docs)
      select doc_id, array_to_string(hits, '|') as hits, len(hits) >= 2 as is_commercial from x""",
    "significance": f"""with {DOCS}, a as (select doc_id as id, title from docs), {title_pairs('a')}
      select a.id, round((1 - coalesce(similarity, 0)) * 10, 1) as score from a left join best using (id)""",
    "lead_summary": f"""with a as (select doc_id as id, text from documents), {tfidf_ctes('a')}
      select id, summary from lead""",
    "top_tag": f"""with a as (select doc_id as id, text from documents), {tfidf_ctes('a')}
      select id, tag from toptag""",
    "prompt_build": f"""with {DOCS}, {HISTORY} select doc_id, {PROMPT} as prompt from docs, hist""",
    "prompt_budget": f"""with {DOCS}, {HISTORY}, p as (select source, {PROMPT} as prompt from docs, hist),
      s as (select source, length(prompt) as chars, len({words('prompt')}) as n_words from p)
      select source, count(*) as prompts, sum(chars) as chars, sum(n_words) as n_words,
        quantile_cont(n_words, 0.5) as median_words, quantile_cont(n_words, 0.9) as p90_words
      from s group by source""",
    "source_summary": f"""with {DELIVERED}
      select source, count(*) as articles, count(distinct url) as links, count(*) filter (com) as commercial,
        count(*) filter (dbl) as doubles, round(avg(com::int), 4) as commercial_share,
        round(avg(dbl::int), 4) as double_share, round(avg(score), 4) as mean_score
      from delivered group by source""",
    "source_links": "select source, count(distinct doc_id) as links, true as near from documents group by source",
    "tag_rollup": f"""with {DELIVERED}
      select coalesce(source, 'all') as source, coalesce(tag, 'all') as tag,
        grouping(source, tag)::int as level, count(*) as articles, round(avg(score), 4) as mean_score
      from delivered group by rollup (source, tag)""",
    "enrich": f"""with {DOCS}
      select link, doc_id % 2 = 0 as is_double, case when doc_id % 2 = 0 then title else '-' end as similar_article,
        case when doc_id % 2 = 0 then lang else '-' end as similarity_reason,
        len({commercial('text')}) >= 2 as is_commercial, (doc_id % 101) / 10.0::double as score,
        title as summary, case when doc_id % 3 = 0 then '' else source end as tags, true as parse_ok
      from docs""",
    "article_pipeline": f"""with {CHOSEN},
      art as (select doc_id as id, title, {cleaned('text')} as text, link, feed_ord from chosen),
      a as (select id, title from art union all
        select doc_id - 1000000000, title from docs where doc_id in (select doc_id from labels)),
      {title_pairs('a')}, {tfidf_ctes('art')}
      select link, 'Feed ' || feed_ord as source, art.text, match_id is not null as is_double,
        coalesce(o.title, '-') as similar_article,
        case when match_id is null then '-' else array_to_string(list_sort(list_intersect(x.w, y.w)), ' ') end as similarity_reason,
        len({commercial("(art.title || ' ' || art.text)")}) >= 2 as is_commercial,
        round((1 - coalesce(similarity, 0)) * 10, 1) as score, coalesce(summary, '') as summary,
        coalesce(tag, '') as tags, true as parse_ok
      from art left join best using (id) left join a o on o.id = match_id left join tw x on x.id = art.id
        left join tw y on y.id = match_id left join lead on lead.id = art.id left join toptag on toptag.id = art.id""",
    "stream_dedup": f"""select event_type as feed_url, {EVENT_LINK} as link, strftime(ts, {ISO}) as fetched_at from events""",
    "stream_counts": f"""with w as (select time_bucket(interval 10 minutes, ts) as s, event_type, count(*) as arrivals
        from events group by 1, 2)
      select strftime(s, {ISO}) as window_start, event_type as feed_url, arrivals from w""",
    "snapshot_ttl": f"""with w as (select time_bucket(interval 5 minutes, ts) as s, event_type,
        arg_min(event_id, ts) as first_id, min(ts) as first_ts, count(*) as snapshots from events group by 1, 2)
      select strftime(s, {ISO}) as window_start, event_type as feed_url, 'https://news.example/e/' || first_id as link,
        strftime(first_ts, {ISO}) as fetched_at, snapshots from w""",
    "stream_intake": f"""select {EVENT_LINK} as url, case when event_type = 'purchase' then 'known' else event_type end as source,
        strftime(ts, {ISO}) as date from events""",
    "stream_retention": f"""with r as (select *, row_number() over (order by ts, event_id) as rn from events)
      select {EVENT_LINK} as url, case when event_type = 'purchase' then 'known' else event_type end as source,
        strftime(ts, {ISO}) as date from r where rn > 100 or (select count(*) from events) <= 400""",
    "stream_articles": f"""with {DOCS}, ranked as (
      select *, row_number() over (partition by source order by doc_id) as rk from docs),
      a as (select link, title, feed_ord, coalesce(nullif({article_text('html')}, ''), trim(text, {BLANKS})) as raw
        from ranked left join pages on page_id = doc_id where rk <= 30 and feed_ord < 18),
      c as (select *, {cleaned('raw')} as content from a)
      select link as url, translate(title, '"«»', '''''''') as title, translate(content, '"«»', '''''''') as content,
        'Feed ' || feed_ord as source, len({commercial("(title || ' ' || content)")}) >= 2 as is_commercial from c""",
}
