"""Fixed values.

Every list and table in this file is data that results depend on: labels, relation
names, aliases, stop words, patterns, MIME types, limits and output texts. They are
plain values, not logic, and are kept together so that a caller can review or replace them.
"""

# --- Ontology -------------------------------------------------------------

ENTITY_LABELS = [
    "PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT",
    "PRODUCT", "DOCUMENT", "DATE", "WORK_OF_ART", "OTHER",
]

# Alias -> canonical name.
LABEL_ALIASES = {
    "ORG": "ORGANIZATION",
    "COMPANY": "ORGANIZATION",
    "CORPORATION": "ORGANIZATION",
    "CORP": "ORGANIZATION",
    "BUSINESS": "ORGANIZATION",
    "ORGANISATION": "ORGANIZATION",
    "INSTITUTION": "ORGANIZATION",
    "AGENCY": "ORGANIZATION",
    "GROUP": "ORGANIZATION",
    "PEOPLE": "PERSON",
    "HUMAN": "PERSON",
    "INDIVIDUAL": "PERSON",
    "PLACE": "LOCATION",
    "GPE": "LOCATION",
    "COUNTRY": "LOCATION",
    "CITY": "LOCATION",
    "REGION": "LOCATION",
    "TIME": "DATE",
    "DATETIME": "DATE",
    "YEAR": "DATE",
    "TECHNOLOGY": "PRODUCT",
    "TECH": "PRODUCT",
    "TOOL": "PRODUCT",
    "SOFTWARE": "PRODUCT",
    "APP": "PRODUCT",
    "SERVICE": "PRODUCT",
    "ARTWORK": "WORK_OF_ART",
    "WORKOFART": "WORK_OF_ART",
    "ARTICLE": "DOCUMENT",
    "BOOK": "DOCUMENT",
    "REPORT": "DOCUMENT",
    "PAPER": "DOCUMENT",
    "THEORY": "CONCEPT",
    "METHOD": "CONCEPT",
    "IDEA": "CONCEPT",
    "MISC": "OTHER",
    "UNKNOWN": "OTHER",
}

TYPE_PRIORITY = {
    "PERSON": 5, "ORGANIZATION": 4, "LOCATION": 4, "PRODUCT": 3, "WORK_OF_ART": 3,
    "EVENT": 3, "DOCUMENT": 3, "CONCEPT": 2, "DATE": 2, "OTHER": 1,
}

RELATION_TYPES = [
    "PART_OF", "LOCATED_IN", "MEMBER_OF", "CAUSES", "LEADS_TO", "ENABLES", "PRECEDES",
    "HAPPENED_ON", "DURING", "CREATED_BY", "OWNS", "AUTHORED_BY", "SIGNED_BY", "WORKS_FOR",
    "MANAGES", "REPORTS_TO", "COLLABORATES_WITH", "STUDIES_AT", "DIRECTOR_OF", "REFERENCES",
    "RELATED_TO",
]

SYSTEM_RELATIONS = [
    "MENTIONS", "COOCCURS_WITH", "CONTAINS", "HAS_CHUNK", "NEXT_CHUNK", "NEXT",
    "BELONGS_TO", "IN_COMMUNITY",
]

# Alias -> canonical name.
RELATION_ALIASES = {
    "WORKS_AT": "WORKS_FOR",
    "WORK_AT": "WORKS_FOR",
    "WORKING_AT": "WORKS_FOR",
    "WORK_FOR": "WORKS_FOR",
    "WORKING_FOR": "WORKS_FOR",
    "EMPLOYED_AT": "WORKS_FOR",
    "EMPLOYED_BY": "WORKS_FOR",
    "IS_EMPLOYEE_OF": "WORKS_FOR",
    "EMPLOYEE_OF": "WORKS_FOR",
    "LAM_VIEC_TAI": "WORKS_FOR",
    "INTERNS_AT": "WORKS_FOR",
    "INTERN_AT": "WORKS_FOR",
    "INTERNSHIP_AT": "WORKS_FOR",
    "THUC_TAP_TAI": "WORKS_FOR",
    "STUDY_AT": "STUDIES_AT",
    "HOC_TAI": "STUDIES_AT",
    "GIAM_DOC": "DIRECTOR_OF",
    "DIRECTOR": "DIRECTOR_OF",
    "CEO_OF": "DIRECTOR_OF",
    "HEAD_OF": "DIRECTOR_OF",
    "QUAN_LY": "MANAGES",
    "MANAGER_OF": "MANAGES",
    "MANAGE": "MANAGES",
    "BAO_CAO_CHO": "REPORTS_TO",
    "REPORT_TO": "REPORTS_TO",
    "THANH_VIEN": "MEMBER_OF",
    "BELONGS_TO_ORG": "MEMBER_OF",
    "MEMBER": "MEMBER_OF",
    "O_TAI": "LOCATED_IN",
    "LOCATION_OF": "LOCATED_IN",
    "LOCATED_AT": "LOCATED_IN",
    "IN_LOCATION": "LOCATED_IN",
    "THUOC": "PART_OF",
    "SUBSIDIARY_OF": "PART_OF",
    "DIVISION_OF": "PART_OF",
    "KY_BOI": "SIGNED_BY",
    "CREATED": "CREATED_BY",
    "MADE_BY": "CREATED_BY",
    "DEVELOPED_BY": "CREATED_BY",
    "WRITTEN_BY": "AUTHORED_BY",
    "AUTHOR_OF": "AUTHORED_BY",
    "OWNED_BY": "OWNS",
    "OWNER_OF": "OWNS",
    "ACQUIRED": "OWNS",
    "ACQUIRES": "OWNS",
    "HOP_TAC": "COLLABORATES_WITH",
    "COLLABORATE_WITH": "COLLABORATES_WITH",
    "PARTNER_WITH": "COLLABORATES_WITH",
    "CAUSE": "CAUSES",
    "CAUSED_BY": "CAUSES",
    "RESULTS_IN": "LEADS_TO",
    "LEAD_TO": "LEADS_TO",
    "REFERENCE": "REFERENCES",
    "REFERS_TO": "REFERENCES",
    "CITES": "REFERENCES",
    "LIEN_QUAN": "RELATED_TO",
    "RELATED": "RELATED_TO",
}

MAX_RELATION_LENGTH = 60
RELATED_WEIGHT = 2.0
COOCCURRENCE_WEIGHT = 1.0
SEMANTIC_WEIGHT_FACTOR = 1.25

# --- Names ----------------------------------------------------------------

# Normalised alias -> display name; the order decides between aliases that differ by spaces only.
NAME_ALIASES = [
    ("tp hcm", "TP. Hồ Chí Minh"),
    ("tp ho chi minh", "TP. Hồ Chí Minh"),
    ("thanh pho ho chi minh", "TP. Hồ Chí Minh"),
    ("hcm", "TP. Hồ Chí Minh"),
    ("sai gon", "TP. Hồ Chí Minh"),
    ("ha noi", "Hà Nội"),
    ("tp ha noi", "Hà Nội"),
    ("thanh pho ha noi", "Hà Nội"),
    ("da nang", "Đà Nẵng"),
    ("tp da nang", "Đà Nẵng"),
    ("can tho", "Cần Thơ"),
    ("hai phong", "Hải Phòng"),
    ("tp hai phong", "Hải Phòng"),
    ("usa", "Hoa Kỳ"),
    ("us", "Hoa Kỳ"),
    ("hoa ky", "Hoa Kỳ"),
    ("united states", "Hoa Kỳ"),
    ("uk", "Vương quốc Anh"),
    ("anh quoc", "Vương quốc Anh"),
    ("openai", "OpenAI"),
    ("open ai", "OpenAI"),
    ("google", "Google"),
    ("microsoft", "Microsoft"),
    ("meta", "Meta"),
    ("facebook", "Meta"),
    ("anthropic", "Anthropic"),
    ("rag", "RAG"),
    ("llm", "LLM"),
    ("graphrag", "GraphRAG"),
    ("knowledge graph", "Knowledge Graph"),
]

PRONOUNS = [
    "toi", "tao", "minh", "ta", "chung toi", "chung ta",
    "ban", "anh", "chi", "em", "ong", "ba", "co", "chu", "bac",
    "ho", "no", "y", "nguoi ta", "han", "ay", "kia",
    "nay", "do", "day",
]

GENERIC_NAMES = ["nguoi", "cong ty", "to chuc", "he thong"]

PERSON_TITLES = [
    "ông", "ong", "bà", "ba", "anh", "chị", "chi", "cô", "co", "chú", "chu", "bác", "bac",
    "mr", "mrs", "ms", "dr", "ts", "ths", "gs", "pgs", "ku", "ngài", "ngai",
]

FUZZY_THRESHOLD = 85
FUZZY_MIN_LENGTH = 4
RELATION_VECTOR_THRESHOLD = 0.75

# --- Questions ------------------------------------------------------------

ENTITY_LINK_STOPWORDS = [
    "va", "voi", "gi", "co", "la", "ai", "khong", "quan", "he", "nhau", "moi",
    "giua", "the", "nao", "mot", "cac", "cua", "trong", "nhu", "thi", "hay",
    "hoac", "neu", "khi", "da", "se", "duoc", "cho", "tu", "den", "biet",
    "ve", "ban", "toi", "nay", "do", "kia", "lam", "viec", "dau", "bao",
    "nhieu", "ra", "sao", "vay", "day", "them", "cung", "chi", "con", "chua",
    "lien", "ket", "noi",
]

QUESTION_STOPWORDS = [
    "la", "là", "cua", "của", "toi", "tôi", "ban", "bạn", "trong", "the", "a", "an",
    "is", "are", "va", "và", "and", "or", "cho", "for", "ve", "về", "gi", "gì",
    "what", "how", "do", "does", "did", "my", "me", "your", "documents", "tai",
    "lieu", "tài", "liệu", "file", "files",
]

FACTUAL_PATTERNS = [
    r"\bai\b", r"\blà ai\b", r"\bwho\b",
    r"\bkhi nào\b", r"\bngày\b", r"\bwhen\b",
    r"\bở đâu\b", r"\bo dau\b", r"\bwhere\b",
    r"\bbao nhiêu\b", r"\bmấy\b", r"\bhow many\b", r"\bwhich\b",
    r"\blà gì\b", r"\bla gi\b", r"\bwhat is\b", r"\bwhat are\b", r"\bdefine\b",
    r"\bliên quan\b", r"\blen quan\b", r"\bquan hệ\b", r"\bquan he\b",
    r"\brelated\b", r"\bbelongs\b", r"\bthuộc\b", r"\bthuoc\b",
    r"\blà ai là\b", r"\bcông ty nào\b", r"\bcong ty nao\b",
    r"\bwhich company\b", r"\bwhich organization\b",
]

DESCRIPTIVE_PATTERNS = [
    r"\btóm tắt\b", r"\btom tat\b", r"\bsummarize\b", r"\bsummary\b",
    r"\btổng quan\b", r"\btong quan\b", r"\boverview\b",
    r"\bmô tả\b", r"\bmo ta\b", r"\bdescribe\b", r"\bdescription\b",
    r"\bgiải thích\b", r"\bgiai thich\b", r"\bexplain\b",
    r"\bphân tích\b", r"\bphan tich\b", r"\banalyze\b",
    r"\bchủ đề\b", r"\bchu de\b", r"\btopic\b", r"\btheme\b",
    r"\blĩnh vực\b", r"\blinh vuc\b", r"\bsubject\b",
    r"\bxu hướng\b", r"\bxu huong\b", r"\btrend\b",
    r"\bbức tranh\b", r"\bbig picture\b",
    r"\bso sánh\b", r"\bso sanh\b", r"\bcompare\b", r"\bdifference\b",
    r"\btại sao\b", r"\btai sao\b", r"\bvì sao\b", r"\bwhy\b",
    r"\bnói về gì\b", r"\bnoi ve gi\b", r"\babout what\b",
]

RELATIONSHIP_PATTERNS = [
    r"\bla gi cua nhau\b", r"\blà gì của nhau\b",
    r"\bquan he giua\b", r"\bquan hệ giữa\b",
    r"\bmoi quan he\b", r"\bmối quan hệ\b",
    r"\blien quan gi\b", r"\bliên quan gì\b",
    r"\brelationship between\b", r"\bhow are .+ related\b",
    r"\brelated to each other\b", r"\bconnection between\b",
    r"\bco lien quan gi\b", r"\bcó liên quan gì\b",
]

LIST_DOCUMENTS_PATTERNS = [
    r"tôi (đang )?có (những )?gì",
    r"co nhung gi",
    r"danh sách tài liệu",
    r"liệt kê tài liệu",
    r"có bao nhiêu tài liệu",
    r"what (documents|files) do i have",
]

TOPIC_PATTERNS = [
    r"(những )?lĩnh vực nào",
    r"(nhung )?linh vuc nao",
    r"(những )?chủ đề nào",
    r"(nhung )?chu de nao",
    r"bạn (có thể )?trả lời (được )?(những )?(gì|câu hỏi|chủ đề|nội dung)",
    r"ban co the tra loi (duoc )?(nhung )?gi",
    r"(tôi|mình) (có thể )?hỏi (về )?(những )?gì",
    r"(toi|minh) (co the )?hoi (ve )?(nhung )?gi",
    r"what (topics|subjects|areas)",
    r"what can you (answer|help)",
]

# Question type -> vector weight, character budgets per context section.
ALPHA_BY_TYPE = {"factual": 0.3, "descriptive": 0.85, "combined": 0.6}
BUDGETS_BY_TYPE = {
    "factual": {"community": 800, "graph": 2000},
    "descriptive": {"community": 1500, "graph": 500},
    "combined": {"community": 1000, "graph": 1500},
}
CONTEXT_MAX_CHARS = 8000

# --- Answers --------------------------------------------------------------

REFUSAL_PATTERNS = [
    r"không tìm thấy",
    r"khong tim thay",
    r"không có thông tin",
    r"khong co thong tin",
    r"không có trong tài liệu",
    r"khong co trong tai lieu",
    r"không nằm trong",
    r"i (?:could not|cannot|can't) find",
    r"not found in (?:your )?documents",
    r"no (?:relevant )?information",
]

AUTO_SCORE_REFUSALS = [
    "khong tim thay", "khong co thong tin", "khong du thong tin", "toi khong tim thay",
]

QUESTION_CATEGORIES = ["factual", "descriptive", "relationship", "combined", "edge_case"]

# --- Files ----------------------------------------------------------------

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
WORKSPACE_PREFIX = "application/vnd.google-apps."

# MIME type -> (extension, label in listings)
SUPPORTED_MIME = {
    "application/pdf": (".pdf", "PDF"),
    DOCX: (".docx", "DOCX"),
    "application/msword": (".doc", "DOC"),
    XLSX: (".xlsx", "XLSX"),
    "application/vnd.ms-excel": (".xls", "XLS"),
    "application/vnd.google-apps.document": (".docx", "Google Docs"),
    "application/vnd.google-apps.spreadsheet": (".xlsx", "Google Sheets"),
}

EXPORT_MIME = {
    "application/vnd.google-apps.document": (DOCX, ".docx"),
    "application/vnd.google-apps.spreadsheet": (XLSX, ".xlsx"),
}

INVENTORY_LABELS = {
    "application/pdf": "PDF",
    DOCX: "Word",
    "application/msword": "Word",
    "application/vnd.google-apps.document": "Google Docs",
    XLSX: "Excel",
    "application/vnd.ms-excel": "Excel",
    "application/vnd.google-apps.spreadsheet": "Google Sheets",
    "text/plain": "TXT",
}

SKIPPED_MIME = [
    "image/png", "image/jpeg", "image/gif", "image/webp", "video/mp4", "video/avi",
    "audio/mpeg", "audio/wav", "application/zip", "application/x-rar-compressed",
    "application/octet-stream", "application/x-msdownload",
]

READER_BY_MIME = {
    "application/pdf": "pdf",
    DOCX: "docx",
    "application/msword": "doc",
    XLSX: "xlsx",
    "application/vnd.ms-excel": "xls",
    "text/plain": "text",
    "text/markdown": "text",
    "text/html": "text",
    "text/csv": "csv",
    "image/jpeg": "ocr",
    "image/png": "ocr",
    "image/webp": "ocr",
    "image/bmp": "ocr",
}

MIN_FILE_BYTES = 100
MAX_FILE_BYTES = 50_000_000
LINK_PREFIX = "https://drive.google.com/file/d/"

# --- Chunks and retrieval -------------------------------------------------

CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
MIN_FLUSH = 200
ANCHOR_CHARS = 100
CHARS_PER_PAGE = 2500
MIN_EXTRACTION_CHARS = 50
EXTRACTION_BATCH = 8
EXTRACTION_BATCH_CHARS = 1200
EXTRACTION_SINGLE_CHARS = 2000

TOP_K = 5
MIN_SCORE = 0.12
VECTOR_WEIGHT = 0.80
KEYWORD_WEIGHT = 0.20
CANDIDATE_MULTIPLIER = 3
MAX_CANDIDATES = 50
COMMUNITY_MIN_SIZE = 3

# --- Output texts ---------------------------------------------------------

SOURCE_LABELS = {
    "vector": "Tài liệu",
    "graph": "Đồ thị tri thức",
    "hybrid": "Tài liệu + Đồ thị",
    "community": "Tổng quan chủ đề",
}
UNKNOWN_SOURCE_LABEL = "Nguồn"
EMPTY_CONTEXT = "Không tìm thấy thông tin liên quan trong knowledge base."
FACTS_TITLE = "=== SỰ THẬT TỪ KNOWLEDGE GRAPH ==="
PATHS_TITLE = "=== QUAN HỆ GRAPH (PATH) ==="
GRAPH_TITLE = "=== QUAN HỆ & SỰ THẬT (GRAPH) ==="
VECTOR_TITLE = "=== ĐOẠN VĂN BẢN TÀI LIỆU (VECTOR) ==="
COMMUNITY_TITLE = "=== TỔNG QUAN CHỦ ĐỀ (COMMUNITY) ==="
PROMPT_OPEN = "=== TÀI LIỆU THAM KHẢO (CONTEXT) ==="
PROMPT_CLOSE = "=== HẾT CONTEXT ==="
SECTION_SEPARATOR = "\n\n---\n\n"
