"""Word lists, patterns and formats that results depend on.  Java syntax; data, not logic."""

# The name space of deterministic ids.
NAMESPACE = "c1d2e3f4-5a6b-7c8d-9e0f-1a2b3c4d5e6f"

PREFIXES = {
    "eli": "http://data.europa.eu/eli/ontology#",
    "dct": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "org": "http://www.w3.org/ns/org#",
    "reg": "http://example.org/reg/ontology#",
    "doc": "http://example.org/reg/doc/",
    "term": "http://example.org/reg/term/",
    "orgn": "http://example.org/reg/org/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}

# White space as Python counts it.
SPACE = r"(?U)[\s\x1c-\x1f]+"

ARTICLE_SPLIT = r"(?U)(?=제\s*\d+\s*조\s*\()"
ARTICLE_HEAD = r"(?U)^제\s*(\d+)\s*조\s*\(([^)]{1,40})\)"
CITATION = r"[「『]([^」』]{2,40})[」』]"
STATUTE_SUFFIX = r"(?:법|법률|시행령|시행규칙|령|규칙)$"
TITLE_SUFFIXES = ("법", "법률", "시행령", "시행규칙", "령", "규칙", "규정", "지침", "기준", "요령", "세칙", "정관", "고시", "훈령", "예규")

DATE_LONG = r"(?U)(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})"
DATE_SHORT = r"(?U)(?<!\d)[‘'`]?(\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})"
DATE_LOCAL = r"(?U)(\d{4})\s*[.\-]\s*(\d{1,2})\s*[.\-]\s*(\d{1,2})"

DEFINITION = r"""(?sU)\d+\.\s*["“”‘’']([^"“”‘’']{1,30})["“”‘’']\s*(?:이?란|이라\s*함은)\s*(.+?)(?=\n\s*\d+\.|\z)"""
DEFINITION_ARTICLE = r"(?U)제\s*\d+\s*조\s*\(\s*정의\s*\)"
DEFINITION_END = r"(?dU)^.{4,}?다\s*[.\n]"

ALIAS = (
    r"(?U)[「『]([^」』]{3,40})[」』]\s*\(?\s*(?:이하|약칭)\s*[「『“\"']?([^」』”\"',)\n]{3,30}?)[」』”\"']?\s*"
    r"(?:이?라고?|이라\s*함)?\s*(?:한다|함|칭한다)"
)
GENERIC_ALIASES = ("규정", "기준", "요령", "지침", "세칙", "법", "이법", "본법", "당규정", "이규정", "본규정", "이기준", "본기준", "동법", "약칭")

ORGANISATION = r"(?s)([가-힣A-Za-z0-9·]{2,14}(?:위원회|심의회|협의회|이사회))(?=(.{0,25}))"
ORGANISATION_LEAD = r"^[oO·∙‧\-*ㅇ\s]+"
ORGANISATION_REJECT = (
    r"\d"
    r"|위원장|위원이|위원을|위원은|위원의"
    r"|따른|따라|위한|위하|위해|참여|갖춘|필요|경우|이내|부터|까지|또는|관한|대한|대하|통하|받아|거쳐|걸쳐|관련|해당|만들|청취|초안|저항|한후|및"
    r"|하여|하며|하기|하고|하는|되는|되어|시키|정한|정하|제출|구성하|구성된|운영하|지정하|평가하|포함|분석|심사를|의결을|검토·조정"
    r"|장관은|장은|부서는|기관은|공무원은|지원은|규정에|에따|에관|에는|으로|에서|등은|등의|또한|기타|그밖|이외|및제|및의|및심|결과를|항목을|지식을"
    r"|^(?:의|를|을|및|와|과|란|로)"
)
ESTABLISHED = r"둔다|설치|구성|운영"
ABOLISHED = r"폐지|아니|않"

APPLIES = r"(?s)[「『]([^」』]{2,40})[」』]([^。\n]{0,60}?)준용(?=(.{0,12}))"
NEGATED = r"아니|않"

BAD_TITLE = r"[|]|---|\.json$|_원문파일_"
BAD_TITLE_START = r"""^[.,·\-–—'"]"""
BAD_TITLE_DATE = r"(?U)^[\d.\s년월일()~\-]+$"
TITLE_FILE_SUFFIX = r"\.(hwpx|HWPX|json|pdf|PDF|txt)$"
TITLE_FILE_DATE = r"_?\(?\d{4}[.\-]\s*\d{1,2}[.\-]\s*\d{1,2}\)?"
TITLE_DROPPED = ("원문파일", "규정", "지시문서", "업무매뉴얼", "잠정조치", "기준", "요령", "지침")

LEGAL = "법규체"
PROSE = "공문체"
PREFIX_CLASS = {
    "지시문서": "reg:Directive",
    "업무매뉴얼": "reg:Manual",
    "매뉴얼": "reg:Manual",
    "잠정조치": "reg:ProvisionalMeasure",
    "규정": "eli:LegalResource",
}
DOCUMENT_CLASSES = ("eli:LegalResource", "reg:Directive", "reg:Manual", "reg:ProvisionalMeasure", "reg:Document")
SCHEMA_TYPES = ("Class", "Property", "Ontology", "DatatypeProperty", "ObjectProperty", "NamedIndividual")

RELATIONS = {"based_on": "eli:based_on", "applies": "eli:applies", "amends": "eli:amends", "cites": "eli:cites"}
# The server walks these; the library walks WALKED_BY_LIBRARY.
WALKED = ("eli:based_on", "eli:applies", "eli:cites", "eli:amends", "eli:repeals", "dct:relation", "dct:references")
WALKED_BY_LIBRARY = ("eli:based_on", "eli:applies", "eli:cites", "eli:amends", "eli:repeals", "dct:relation", "eli:has_part")
FACT_PREDICATES = ("eli:based_on", "eli:applies", "eli:cites", "eli:amends", "eli:repeals", "dct:references")
PREDICATE_LABEL = {
    "eli:based_on": "위임받음", "eli:applies": "준용", "eli:cites": "참조", "eli:amends": "개정", "eli:repeals": "폐지",
    "dct:relation": "관련", "dct:references": "참조", "eli:date_publication": "제정일", "eli:first_date_entry_in_force": "시행일",
}
PREDICATE_LABEL_LIBRARY = {
    "eli:based_on": "위임", "eli:applies": "준용", "eli:cites": "참조", "eli:amends": "개정", "eli:repeals": "폐지",
    "dct:relation": "관련", "eli:has_part": "포함",
}
FACT_PRIORITY = {"위임받음": 0, "준용": 1, "개정": 2, "폐지": 3, "참조": 4}

STOP_TOKENS = ("업무처리", "업무", "관련", "및", "기준", "규정", "요령", "지침", "적용", "처리", "관리", "에", "관한", "은", "는", "이", "가")
GENERIC_TOKENS = ("관련", "관한", "및", "에", "의", "규정", "기준", "요령", "지침", "세칙", "방법", "규칙")

OUTLINE_SPLIT = r"(?U)(?=\n\s*(?:제\s*\d+\s*[장절]|[ⅠⅡⅢⅣⅤⅥ]\.|\d{1,2}\.\s))"
SENTENCE_SPLIT = r"(?U)(?<=[.。!?·])\s+|(?<=다\.)\s+"
AUTH_FAILURE = "사용자 정보 검증"
MANUAL_HINT = "매뉴얼|안내서|가이드|편람|지침서|운영요령|핸드북|업무처리요령"
ATTACHMENT_AUXILIARY = "별표|별지|서식|양식|샘플|템플릿|표지"
