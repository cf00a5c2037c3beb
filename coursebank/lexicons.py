"""Labels, word lists, phrase lists and character classes.

Everything in this module must have exactly these values for results to be right.
"""

# --- fixed values: level labels -------------------------------------------------

BLOOM_LABELS = (
    "Bloom 1 (Nhớ)", "Bloom 2 (Hiểu)", "Bloom 3 (Vận dụng)",
    "Bloom 4 (Phân tích)", "Bloom 5 (Đánh giá)", "Bloom 6 (Sáng tạo)",
)

# Key contained in a label -> level; the first key that occurs decides.
BLOOM_KEYS = {
    "knowledge": 1, "nhớ lại": 1, "comprehension": 2, "understand": 2,
    "application": 3, "apply": 3, "ứng dụng": 3, "áp dụng": 3,
    "analysis": 4, "analyze": 4, "evaluation": 5, "evaluate": 5,
    "synthesis": 6, "create": 6, "tạo dựng": 6,
    "nhớ": 1, "hiểu": 2, "vận dụng": 3, "phân tích": 4, "đánh giá": 5, "sáng tạo": 6,
}

DEFAULT_POINTS = {1: 1.0, 2: 1.5, 3: 2.0, 4: 2.5, 5: 3.0, 6: 3.5}
POINT_VALUE = 0.25
POINT_CAPS = {3: 6, 5: 10, 6: 10}

# --- fixed values: stop words ---------------------------------------------------

STOP_WORDS = (
    "của", "và", "các", "trong", "được", "với", "cho", "từ", "này", "như", "để",
    "theo", "một", "những", "đến", "việc", "trên", "hay", "có", "khi", "hoặc",
    "là", "sẽ", "tại", "nên", "mà", "bằng", "đã", "đang", "vào", "ra",
    "bởi", "về", "giữa", "nếu", "sau", "trước", "thì", "đây", "đó", "cũng", "không",
    "phần", "bài", "còn", "rất", "nhiều", "hơn", "nhất", "do", "vì", "mỗi",
)

CLO_STOP_WORDS = (
    "và", "của", "cho", "trong", "theo", "được", "các", "một", "này", "that",
    "with", "from", "have", "been", "the", "for", "are", "was",
)

BLEU_STOP_WORDS = (
    "và", "các", "của", "là", "trong", "để", "có", "một", "sự", "như",
    "này", "cho", "với", "ra", "được", "năm", "vào", "từ", "theo", "khi",
    "đã", "sẽ", "đang", "không", "về", "tại", "hay", "hoặc", "thì",
    "nên", "mà", "do", "bởi", "vì", "sau", "trước", "nếu", "giữa",
)

SUPPORT_STOP_WORDS = (
    "của", "và", "là", "các", "có", "được", "trong", "cho", "với", "này",
    "để", "từ", "khi", "đã", "không", "một", "những", "theo", "về",
    "trên", "bằng", "hay", "hoặc", "nếu", "thì", "do", "mà", "cũng",
    "như", "đến", "tại", "còn", "nên", "rất", "sẽ", "vì", "nhưng",
    "qua", "mỗi", "đó", "nó", "hơn", "sau", "cần", "lại", "ra",
    "giữa", "việc", "đều", "bị", "vào", "lên",
)

KEYWORD_STOP_WORDS = (
    "của", "và", "các", "trong", "được", "với", "cho", "từ", "này", "như", "để",
    "theo", "một", "những", "đến", "việc", "trên", "hay", "có", "khi", "hoặc",
    "bởi", "về", "giữa", "nếu", "sau", "trước", "thì", "đây", "đó", "cũng", "không",
    "là", "sẽ", "tại", "nên", "mà", "bằng", "đã", "đang", "vào", "ra", "lần",
    "phần", "bài", "giáo", "trình", "học", "sinh", "viên",
    "khách", "hàng", "mại", "điểm", "thương",
)

KEYWORD_BLACKLIST = ("toán điện", "điện toán", "mại điểm", "hàng mại")

FILLER_WORDS = (
    "các", "những", "một", "vài", "trong", "tới", "sắp", "thời", "gian",
    "liên", "quan", "về", "như", "sau", "này", "đó", "the", "and", "for", "with",
    "upcoming", "future", "related", "general", "common", "issues", "aspects",
)

WEAK_TITLE_WORDS = (
    "khả", "năng", "tiềm", "tương", "lai", "cốt", "lõi", "giai", "đoạn",
    "mục", "đích", "vai", "trò", "ý", "nghĩa", "thời", "điểm", "ban", "đầu",
    "core", "future", "potential", "capability", "initial", "stage", "aspect",
)

WEAK_CONTENT_WORDS = (
    "internet", "mạng", "lưới", "hệ", "thống", "thương", "mại", "điện", "tử",
    "phát", "triển", "tạo", "điều", "kiện", "trong", "các", "cho", "được",
    "network", "system", "development", "global", "computer", "computers",
)

GENERIC_PHRASES = (
    "trong thời gian", "theo tài liệu", "điều này", "điều đó", "của internet",
    "của mạng", "trong giai đoạn", "sự phát triển", "đã tạo", "điều kiện cho",
    "một mạng", "các mục", "các mục đích", "in the", "of the", "this is",
    "that is", "as a", "for the",
)

# --- fixed values: phrase lists of the question and answer rules -----------------

TEMPLATE_MARKERS = (
    "phân tích định tính", "phân tích định lượng", "khả năng mở rộng", "tiếp cận đa chiều",
    "chỉ số kpi", "trải nghiệm người dùng cuối", "khối lượng công việc tăng dần",
    "lớp hạ tầng cơ sở", "lớp ứng dụng logic cấp cao", "qualitative analysis",
    "quantitative analysis", "multi-dimensional approach", "end-user experience", "workload increases",
)

GENERIC_TEMPLATES = (
    "khả năng mở rộng", "tiếp cận đa chiều", "chỉ số kpi",
    "trải nghiệm người dùng cuối", "lớp hạ tầng cơ sở", "lớp ứng dụng logic cấp cao",
)

BOILERPLATE_PHRASES = (
    "phân tích định tính", "phân tích định lượng", "chỉ số kpi", "khả năng mở rộng", "tiếp cận đa chiều",
)

LEVEL1_OFF_LEVEL = (
    "khía cạnh cần xem xét", "các khía cạnh cần", "phương pháp phân tích", "phân tích được đề cập",
    "phân tích được trình bày", "phân tích các", "phân tích những", "phân tích vai trò", "phân tích khi",
    "phân tích trong", "phân tích mối", "đánh giá vai trò", "đánh giá tầm", "đánh giá các", "so sánh",
    "mối quan hệ giữa", "ưu nhược", "cần xem xét khi", "thách thức khi", "thách thức và phương",
    "những thách thức khi", "các thách thức khi", "các thách thức và",
)

LEVEL2_OFF_LEVEL = (
    "khía cạnh cần xem xét", "các khía cạnh cần", "phương pháp phân tích", "phân tích được đề cập",
    "phân tích được trình bày", "phân tích các khía cạnh", "phân tích những thách thức",
    "phân tích vai trò và", "phân tích mối quan hệ", "phân tích khi", "đánh giá vai trò", "đánh giá tầm",
    "so sánh ưu", "ưu nhược", "mối quan hệ giữa", "tại sao việc", "đòi hỏi sự hiểu biết",
    "cần xem xét khi", "thách thức khi triển",
)

LEVEL3_OFF_LEVEL = (
    "phân tích các", "phân tích những", "phân tích vai trò", "phân tích mối", "phân tích khi",
    "phân tích được", "phương pháp phân tích", "các khía cạnh cần", "khía cạnh cần xem xét",
    "đánh giá vai trò", "đánh giá tầm", "đánh giá hiệu quả", "đánh giá ban đầu", "các bước đánh giá",
    "so sánh", "ưu nhược", "xác định các yếu tố", "các yếu tố cần xem xét", "để đánh giá",
    "để xác định các", "phương pháp phân tích được", "phân tích liên quan",
)

LEVEL1_VERBS = (
    "liệt kê", "nêu ", "kể tên", "định nghĩa", "cho biết",
    "list", "define", "name", "identify", "state", "recall",
)

LEVEL2_VERBS = (
    "giải thích", "mô tả", "trình bày", "lý giải", "làm rõ", "diễn giải",
    "explain", "describe", "summarize", "interpret", "clarify", "outline",
)

LEVEL3_META = (
    "thang đo bloom", "thang bloom", "bộ câu hỏi tự luận", "câu hỏi tự luận",
    "phân loại cao theo", "xây dựng bộ câu hỏi",
)

LEVEL3_SCENARIOS = (
    "giả sử", "tình huống", "trong trường hợp", "nếu ", "khi một", "khi doanh nghiệp",
    "khi người", "khi công ty", "khi cửa hàng", "trong bối cảnh", "để thực hiện",
    "cần triển khai", "cần áp dụng", "muốn bán", "muốn triển khai",
    "suppose", "scenario", "in the case", "if a ", "if an ", "when a ", "when an ",
    "when a company", "when a business", "when a store", "in order to", "to implement",
)

LEVEL3_VERBS = (
    "áp dụng", "vận dụng", "sử dụng", "thực hiện", "triển khai", "tính toán",
    "apply", "use", "implement", "calculate", "demonstrate how", "solve",
)

# Level 2 drift of a level 3 question; the word boundary follows the phrase.
LEVEL3_DRIFT = (
    r"hãy\s+(mô tả|trình bày|giải thích|nêu|liệt kê|cho biết)",
    r"vận dụng[^\n]{0,48}(mô tả|trình bày|giải thích)",
    r"áp dụng[^\n]{0,48}(mô tả|trình bày|giải thích)",
)

LEVEL3_FORBIDDEN_TITLES = (
    "phân tích định tính", "phân tích định lượng", "đánh giá định tính", "đo lường định lượng",
    "khả năng mở rộng", "tiếp cận đa chiều", "chỉ số kpi", "trải nghiệm người dùng", "lớp hạ tầng",
    "lớp ứng dụng logic", "đánh giá hiệu năng", "đối mặt thách thức", "tối ưu hóa thuật toán",
    "lựa chọn phương pháp tiếp cận",
)

LEVEL3_BARE_TITLES = (
    "phân tích định tính", "phân tích định lượng", "đánh giá định tính", "đo lường định lượng",
    "khả năng mở rộng", "tiếp cận đa chiều", "chỉ số kpi",
)

LEVEL3_TITLE_STARTS = ("phân tích định", "đánh giá định", "đo lường định")

ANSWER_META = ("bộ câu hỏi tự luận", "thang đo bloom", "tính phân loại cao", "xây dựng bộ câu hỏi")

ACTION_MARKERS = (
    "bước", "thực hiện", "triển khai", "áp dụng", "chuẩn bị", "xử lý",
    "cấu hình", "huấn luyện", "tính toán", "thiết lập", "step", "apply",
)

LEVEL_VERBS = {
    1: ("liệt kê", "nêu", "kể tên", "định nghĩa", "cho biết", "trình bày",
        "list", "define", "name", "identify", "state", "recall"),
    2: ("giải thích", "mô tả", "lý giải", "làm rõ", "diễn giải", "tóm tắt",
        "explain", "describe", "summarize", "interpret", "clarify"),
    3: ("áp dụng", "vận dụng", "sử dụng", "thực hiện", "tính toán", "triển khai",
        "apply", "use", "implement", "calculate", "demonstrate", "solve"),
    4: ("phân tích", "phân loại", "so sánh", "đối chiếu", "phân biệt", "tìm nguyên nhân",
        "analyze", "analyse", "compare", "contrast", "differentiate", "examine"),
    5: ("đánh giá", "nhận xét", "biện luận", "phản biện", "lập luận", "bình luận",
        "evaluate", "assess", "critique", "argue", "justify"),
    6: ("đề xuất", "thiết kế", "sáng tạo", "xây dựng", "phát triển", "cải tiến",
        "propose", "design", "create", "develop", "recommend", "innovate"),
}

CREATIVE_VERBS = (
    "đề xuất", "thiết kế", "xây dựng", "phát triển", "tạo ra",
    "cải tiến", "đề nghị", "kiến nghị", "sáng tạo",
)

# Heads and tails removed before asking whether a point's content adds information.
FILLER_HEADS = ("các", "những", "về", "liên quan đến", "bao gồm", "gồm", "như", "such as", "including", "related to")
FILLER_TAILS = ("trong thời gian tới", "sắp tới", "trong tương lai", "in the future", "going forward")
SUCH_AS_FILLER = "bao gồm các hoạt động như"

# --- fixed values: feasibility and ceilings --------------------------------------

MIN_CHARS = {1: 150, 2: 200, 3: 220, 4: 280, 5: 350, 6: 350}
MIN_WORDS = {1: 30, 2: 50, 3: 55, 4: 65, 5: 80, 6: 80}

ANALYTIC_SIGNALS = (
    "so sánh", "phân tích", "đánh giá", "mối quan hệ", "nguyên nhân",
    "kết quả", "ảnh hưởng", "tác động", "thiết kế", "đề xuất", "cải tiến",
)
BASIC_SIGNALS = (
    "là", "bao gồm", "gồm có", "các bước", "quy trình", "phương pháp", "nguyên tắc", "định nghĩa",
)

CEILING_KEYWORDS = {
    6: ("đề xuất giải pháp", "thiết kế hệ thống", "xây dựng mô hình", "phát triển giải pháp"),
    5: ("ưu điểm", "nhược điểm", "biện luận", "phản biện", "tiêu chí đánh giá", "hạn chế", "lợi ích"),
    4: ("so sánh", "nguyên nhân", "mối quan hệ", "ảnh hưởng", "tác động", "phân loại", "phân biệt"),
    3: ("các bước", "quy trình", "thực hiện", "tính toán", "áp dụng", "vận dụng"),
    2: ("giải thích", "ý nghĩa", "khái niệm", "bao gồm", "mô tả", "trình bày"),
}

EXACT_KEYWORDS = {
    6: ("thiết kế", "xây dựng", "phát triển", "chế tạo", "tạo ra", "sáng tạo"),
    5: ("đánh giá", "ưu điểm", "nhược điểm", "tuy nhiên", "hạn chế", "lợi thế"),
    4: ("ảnh hưởng", "nguyên nhân", "dẫn đến", "liên quan", "tác động", "khiến"),
    3: ("áp dụng", "sử dụng", "thực hiện", "triển khai", "vận dụng"),
    2: ("giúp", "vì", "do", "bởi", "giải thích", "có nghĩa"),
}

SECTIONS_TRIED = {1: 12, 2: 12, 3: 22, 4: 28, 5: 24, 6: 24}
SECTIONS_TRIED_WITH_CLO = 8
HARD_FLOORS = {1: 0.48, 2: 0.40, 3: 0.26, 4: 0.22, 5: 0.15, 6: 0.15}

# --- fixed values: learning outcomes ----------------------------------------------

CLO_CONCEPT = ("khái niệm", "định nghĩa", "thuật ngữ", "cơ bản", "concept", "definition", "terminology")
CLO_BUILD_TITLES = (
    "xây dựng", "triển khai", "nghiên cứu thị trường", "đối thủ", "mục tiêu và yêu cầu",
    "implement", "deploy", "build",
)
CLO_ADVANCED_TITLES = (
    "omni", "6.", "xây dựng", "triển khai", "bán hàng trên sàn", "lưu ý khi áp dụng", "marketing", "seo",
)
CLO_BASIC_TITLES = ("khái niệm", "giới thiệu", "1.", "2.1", "mô hình", "thuật ngữ", "tổng quan")
CLO_RISK = ("rủi ro", "risk", "an ninh", "bảo mật", "pháp lý")
CLO_SALES_TITLES = ("omni channel", "omni-channel", "bán hàng", "marketing", "seo", "từ khóa")
CLO_TERM_TITLES = ("thuật ngữ", "khái niệm", "giới thiệu")

# Topic -> (words that ask for it in an outcome, words that show it in a text).
CLO_TOPICS = {
    "rui_ro": (("rủi ro", "risk"), ("rủi ro", "risk", "nguy cơ", "threat", "đe dọa", "gian lận")),
    "an_ninh": (("an ninh", "security", "bảo mật"), ("an ninh", "security", "bảo mật", "mật", "hack", "xâm nhập")),
    "thanh_toan": (("thanh toán", "payment"), ("thanh toán", "payment", "giao dịch", "thẻ", "cổng thanh toán")),
    "phap_ly": (("pháp lý", "legal"), ("pháp lý", "legal", "quy định", "luật", "tuân thủ", "trách nhiệm")),
}

CLO_ASPECTS = {
    "loi_ich": (("lợi ích", "ưu điểm", "tác dụng", "benefit", "advantage"),
                ("lợi ích", "ưu điểm", "tác dụng", "giúp", "benefit", "advantage")),
    "han_che": (("hạn chế", "nhược điểm", "khó khăn", "limitation", "drawback", "nhược"),
                ("hạn chế", "nhược", "khó khăn", "điểm yếu", "limitation", "drawback")),
    "vai_tro": (("vai trò", "ý nghĩa", "vị trí", "role", "significance"),
                ("vai trò", "ý nghĩa", "vị trí", "đóng góp", "role")),
    "khai_niem": (("khái niệm", "định nghĩa", "concept", "define", "definition", "cơ bản"),
                  ("khái niệm", "định nghĩa", "là gì", "concept", "definition", "cơ bản",
                   "thương mại điện tử", "tmđt", "e-commerce", "ecommerce")),
    "hoat_dong": (("hoạt động", "quy trình", "bước", "process", "activity"),
                  ("hoạt động", "quy trình", "bước", "process", "activity")),
    "phan_tich": (("phân tích", "analyze", "analysis"),
                  ("phân tích", "analyze", "analysis", "nguyên nhân", "hệ quả", "mối quan hệ",
                   "yếu tố", "tác động", "ảnh hưởng", "vì sao", "dẫn đến", "liên quan")),
    "so_sanh": (("so sánh", "compare", "contrast", "khác biệt"),
                ("so sánh", "compare", "contrast", "khác biệt", "khác nhau")),
    "van_dung": (("vận dụng", "áp dụng", "apply", "implement"),
                 ("vận dụng", "áp dụng", "apply", "implement", "triển khai")),
    "danh_gia": (("đánh giá", "evaluate", "assess", "nhận xét"),
                 ("đánh giá", "evaluate", "assess", "nhận xét")),
    "mo_hinh": (("mô hình", "model", "framework"),
                ("mô hình", "model", "framework", "loại hình", "hình thức",
                 "b2b", "b2c", "c2c", "c2b", "b2g", "c2g", "marketplace", "sàn tmđt")),
    "thuat_ngu": (("thuật ngữ", "terminology", "term", "liên quan"),
                  ("thuật ngữ", "terminology", "term", "ký hiệu", "viết tắt",
                   "edi", "url", "http", "https", "ssl", "vpn", "internet", "website",
                   "online", "offline", "giao dịch điện tử", "tmđt", "e-commerce")),
    **CLO_TOPICS,
}

CLO_ASPECT_LABELS = {
    "loi_ich": "lợi ích", "han_che": "hạn chế", "vai_tro": "vai trò", "khai_niem": "khái niệm/định nghĩa",
    "hoat_dong": "hoạt động/quy trình", "phan_tich": "phân tích", "so_sanh": "so sánh", "van_dung": "vận dụng",
    "danh_gia": "đánh giá", "mo_hinh": "mô hình", "thuat_ngu": "thuật ngữ", "rui_ro": "rủi ro",
    "an_ninh": "an ninh", "thanh_toan": "thanh toán", "phap_ly": "pháp lý",
}

SKILL_ASPECTS = ("phan_tich", "danh_gia", "so_sanh", "van_dung")
CONCEPT_FALLBACK_TITLES = ("khái niệm", "giới thiệu", "tổng quan", "chung")

# --- fixed values: characters -------------------------------------------------------

# Capital letters that may begin a title (inside a character class).
VI_UPPER = "A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴ"

SUBSCRIPTS = {"₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4", "₅": "5", "₆": "6", "₇": "7", "₈": "8", "₉": "9",
              "₊": "+", "₋": "-", "₌": "=", "₍": "(", "₎": ")"}
SUPERSCRIPTS = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9",
                "⁺": "+", "⁻": "-", "⁼": "=", "⁽": "(", "⁾": ")", "ⁿ": "n"}

# Symbols replaced by one ASCII character each, in order.
MATH_SINGLE = {
    "₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4", "₅": "5", "₆": "6", "₇": "7", "₈": "8", "₉": "9",
    "⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9",
    "⁺": "+", "⁻": "-", "∂": "d", "≈": "~", "×": "*", "÷": "/", "·": "*", "Å": "A",
}

# Symbols replaced by a word or a longer operator.
MATH_WORDS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Α": "Alpha", "Β": "Beta", "Γ": "Gamma", "Δ": "Delta", "Ε": "Epsilon", "Θ": "Theta", "Λ": "Lambda",
    "Μ": "Mu", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega",
    "∞": "infinity", "∑": "sum", "∫": "integral", "∇": "nabla", "√": "sqrt", "≤": "<=", "≥": ">=", "≠": "!=",
    "→": "->", "⇒": "=>", "⇌": "<->", "±": "+-", "∝": "prop", "∈": "in", "∉": "not_in", "∀": "for_all",
    "∃": "exists", "∅": "empty", "°": "deg", "µ": "micro",
}

# Character classes, written so that both Java and RE2 read them.
STEM_NARROW = r"\x{0391}-\x{03C9}\x{2200}-\x{22FF}\x{2070}-\x{209F}\x{00B2}\x{00B3}\x{00B1}\x{00D7}\x{00F7}\x{00B0}\x{00B5}"
STEM_WIDE = (r"\x{0391}-\x{03C9}\x{2200}-\x{22FF}\x{2100}-\x{214F}\x{2190}-\x{21FF}\x{2070}-\x{209F}"
             r"\x{00B0}-\x{00B3}\x{00B5}\x{00C5}\x{00D7}\x{00F7}\x{0300}-\x{036F}")
VI_EXTENDED = r"\x{1E00}-\x{1EFF}"

STEM_SIGNALS = (
    "∞", "∑", "∫", "∂", "∇", "±", "≤", "≥", "≠", "≈", "√",
    "α", "β", "γ", "δ", "ε", "ζ", "η", "θ", "λ", "μ", "π", "σ", "τ", "ω",
    "Α", "Β", "Γ", "Δ", "Σ", "Ω",
    "H₂", "O₂", "CO₂", "H₂O", "Fe", "Na", "Cl", "SO₄", "NO₃", "NH₃",
    "Δ", "\u2126", "°C", "°K", "eV", "mol", "pH",
    "→", "⇌", "↔", "⇒",
)

# --- fixed values: answer clean-up, each followed by an optional comma and spaces ------

LEAD_IN_PHRASES = (
    "[Tt]heo tài liệu", "[Dd]ựa trên tài liệu", "[Tt]rong giáo trình", "[Tt]ài liệu cho thấy",
    "[Tt]ài liệu nêu rõ", "[Tt]ài liệu chỉ ra rằng", "[Tt]ài liệu chỉ ra", "[Nn]hư đã nêu trong tài liệu",
    "[Nn]hư đã đề cập", "[Nn]hư đã trình bày", "[Dd]ựa vào nội dung tài liệu", "[Tt]heo như tài liệu",
    "[Dd]ựa trên nội dung giáo trình", "[Dd]ựa theo tài liệu", "[Dd]ược đề cập trong tài liệu",
    "[Tt]heo giáo trình",
)

FILLER_SENTENCES = (
    r"[Vv]iệc này (?:rất |vô cùng )?quan trọng[^.]*\.\s*",
    r"[Đđ]iều này cho thấy[^.]*\.\s*",
    r"[Cc]ó thể thấy rằng,?\s*",
    r"[Nn]hư vậy,?\s*",
    r"[Tt]óm lại,?\s*",
    r"[Tt]ừ đó cho thấy,?\s*",
    r"[Qq]ua đó,?\s*",
    r"[Nn]hìn chung,?\s*",
    r"[Tt]ừ những (?:phân tích|điều) trên,?\s*",
    r"[Cc]hính vì vậy,?\s*",
    r"[Đđ]ây là (?:một )?(?:vấn đề|điều|yếu tố) (?:rất |vô cùng )?quan trọng[^.]*\.\s*",
    r"[Đđ]iều này (?:rất |vô cùng )?(?:quan trọng|cần thiết)[^.]*\.\s*",
    r"[Nn]ói cách khác,?\s*",
    r"[Cc]ần lưu ý rằng,?\s*",
    r"[Tt]heo đó,?\s*",
)

# --- fixed values: title repair -------------------------------------------------------

_V = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"
_CV = "aàáảãạăắằẳẵặâấầẩẫậeèéẻẽẹêếềểễệiìíỉĩịoòóỏõọôốồổỗộơớờởỡợuùúủũụưứừửữựyỳýỷỹỵ"
_C = "bcdđghklmnpqrstvx"

# Rules that join a broken word; applied in order, six times over.
TITLE_JOINS = (
    r"([a-zđ][ươ]) ([ợơ][a-zngmtc]*)",
    r"([a-zđ][ửữự]) ([ôơộồốớờở][a-zngmtc]*)",
    rf"([a-zđ][áảãạ]) ([{_C}])",
    r"([a-zđ]) ([ụăêô][a-zngmtc]+)\b",
    rf"([a-zđ]) ([{_V}][a-z{_V}đ]?)\b",
    rf"([a-zđ]) ([{_V}](?:\s|[,.\-:;()]|$))",
    rf"([{_V}]) ([a-zđ][{_V}])",
)
TITLE_JOIN_ROUNDS = 6
# How much of a text the reference's rules read, in characters (BLEU: sentences, or words where there are none).
OUTCOME_CHARS = 8000
ASPECT_CHARS = 6000
PHRASE_CHARS = 5000
SNIPPET_CHARS = 4500
STRUCTURE_CHARS = 3000
STEM_CHARS, STEM_SIGNAL_CHARS = 2000, 3000
BLEU_SENTENCES, BLEU_WORDS = 7, 200
BLEU_SECTION_SENTENCES = 3

# Rules that part two words run together; the flag says whether case is ignored.
TITLE_SPLITS = (
    (rf"([ửữựộọồốờởỡợ])([dđ][{_V}])", True),
    (r"([àáảãạíỉĩịúủũụ])(ch[ìíỉĩịoòóỏõọ])", True),
    (rf"([ấậếệốộớợứự])(th?[{_V}])", True),
    (rf"\b(và|bảo|đảm|cho|của|các|một|được)([{_C}][{_CV}])", True),
    (rf"([a-z{_V}][nmp])([{_C}][{_CV}])", True),
    (rf"([a-z{_V}đ])([{VI_UPPER}])", False),
)
TITLE_LAST_SPLIT = rf"([ơưôơờớởỡợ])([mđtcklnhbpgvs][{_V}])"

TITLE_PAIRS = (
    ("thông", "báo"), ("công", "cụ"), ("cổng", "cụ"), ("qua", "cổng"), ("trực", "tuyến"), ("điện", "tử"),
    ("doanh", "nghiệp"), ("thực", "phẩm"), ("chức", "năng"), ("hiện", "hành"), ("quy", "định"), ("theo", "quy"),
    ("từ", "một"), ("trở", "đến"), ("khác", "trở"), ("website", "khác"), ("liên", "kết"), ("những", "liên"),
    ("là", "những"), ("chính", "là"), ("backlink", "chính"), ("chất", "lượng"), ("số", "lượng"),
    ("ảnh", "hưởng"), ("thứ", "hạng"), ("từ", "khóa"), ("tìm", "kiếm"), ("quan", "điểm"), ("được", "coi"),
    ("hợp", "lệ"),
)

# --- fixed values: section titles and usability -------------------------------------------

USABLE_TITLES = (
    r"\d+\.\d+",
    r"\d+\.\s+[A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐ]",
    r"(Chương|Phần|Chapter|Part)\s+",
    r"(Bài|Bai|Lesson)\s+\d+",
    r"(Đoạn|Trang) \d+",
    r"(Ví dụ|Example|Định nghĩa|Definition|Theorem|Exercise|Bài tập)\s+",
    r"(Mục|MUC)\s+\d+",
)

# Line starts that open a section.
HEADER_STARTS = (
    r"\d+\.\d+\.\d+(?:\.\d+)?\s+",
    r"\d+\.\d+\s+",
    rf"\d+\.\s+[{VI_UPPER}]",
    r"(?:Chương|CHUONG)\s+[IVX\d]+[:.\s]",
    r"(?:Mục|MUC)\s+[\d.]+[:.\s]",
    r"(?:Phần|PHAN)\s+[IVX\d]+[:.\s]",
    r"(?:Bài|Bai)\s+\d+[.:;)\s]",
    r"Lesson\s+\d+[.:;)\s]",
    r"(?:Chapter|Chap)\s+[IVX\d]+[:.\s]",
)
STEM_HEADER_STARTS = (
    r"(?:Ví dụ|Vi du|Example)\s+[\d.]+[.:)\s]",
    r"(?:Bài tập|Exercise)\s+[\d.]+",
    r"(?:Định lý|Theorem)\s+[\d.]+",
    r"(?:Hệ quả|Corollary|Lemma)\s+[\d.]+",
    r"(?:Định nghĩa|Definition|DEF)\s+[\d.]+",
    r"(?:Mệnh đề|Proposition)\s+[\d.]+",
    r"(?:Chứng minh|Proof)[.:?]?\s*$",
    r"(?:Nhận xét|Chú ý|Remark|NOTE)\s+[\d.]+",
    r"(?:Thuật toán|Algorithm)\s+[\d.]+",
    r"(?:Phản ứng|Reaction)\s+[\d.]+[.:)\s]",
)
VALID_STARTS = (r"\d+\.", r"(?:Chương|Mục|Phần)", r"(?:Bài|Bai|Lesson|Chapter|Chap)\s+\d+")

ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV",
         "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV", "XXV",
         "XXVI", "XXVII", "XXVIII", "XXIX", "XXX")

UNUSABLE_KEYWORDS = (
    "mục lục", "table of contents", "toc", "contents",
    "lời cảm ơn", "acknowledgment", "lời nói đầu", "cảm ơn", "loi noi dau",
    "phụ lục", "appendix", "nguồn tài liệu", "phu luc",
    "tài liệu tham khảo", "references", "bibliography", "tai lieu tham khao",
    "trang bìa", "bìa sách", "cover page",
    "lời giới thiệu", "giới thiệu chung", "introduction", "lời kết", "loi ket",
    "mở đầu", "mo dau", "phần mở đầu", "phan mo dau",
    "conclusion", "tóm tắt", "abstract", "summary", "tom tat",
    "chỉ mục", "index", "danh mục", "mục in đậm", "chi muc",
    "biên tập", "editor", "tác giả", "author", "tac gia",
    "mã qr", "qr code", "scan",
    "chân trang", "footer", "đầu trang", "header",
    "trang ...", "xem thêm trang", "trang số",
    "bài tập", "bai tap", "câu hỏi ôn tập", "cau hoi on tap",
    "hướng dẫn", "thực hành", "bài lab", "huong dan",
)
# Applied to the lowercased title, ignoring case.
INTRO_TITLES = (
    r"^[A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÈÉẺẼẸÊẾỀỂỄỆ\s]{5,40}$",
    r"^(lời|giới thiệu|phần|mở đầu|tổng quan|khái niệm)",
    r"(tổng quan|chung)",
)

# --- fixed values: sentence importance ----------------------------------------------------

METADATA_STARTS = (
    r"Câu\s+\d+[.:]", r"Bài\s+\d+[.:]", r"Ví dụ\s+\d+[.:]", r"Phần\s+\d+[.:]", r"Bài tập\s+\d+[.:]",
    r"\d+[.)]\s*[A-ZÀ-Ỹ][\p{L}\p{N}_]{0,15}\s*:",
)
GENERIC_SENTENCE_PHRASES = (
    "nói chung", "thường thường", "như vậy", "các khái niệm", "nội dung liên quan",
    "được trình bày", "trong mục này", "có thể thấy", "nhận thấy rằng",
    "nội dung chính", "các phần", "phần này", "điểm quan trọng",
)
EXAMPLE_MARKERS = ("ví dụ như", "chẳng hạn", "cụ thể là", "như là", "bao gồm:", "gồm có:")
DEFINITION_MARKERS = ("là", "được định nghĩa", "có nghĩa", "gọi là", "được hiểu", "bao gồm", "gồm có", "như sau",
                      "cụ thể", "ví dụ")

ANSWER_TITLES = {
    1: ("Định nghĩa/Khái niệm", "Các thuật ngữ", "Phân loại", "Thành phần"),
    2: ("Giải thích", "Phân tích chi tiết", "Ý nghĩa", "Ví dụ minh họa"),
    3: ("Cơ sở lý thuyết", "Phương pháp thực hiện", "Ứng dụng thực tế", "Kết quả mong đợi"),
    4: ("Đặc điểm chính", "Các thành phần", "Mối quan hệ", "So sánh"),
    5: ("Vai trò và tác động", "Ưu điểm", "Hạn chế", "Kết luận đánh giá"),
    6: ("Hiện trạng", "Đề xuất cải tiến", "Phương án thực hiện", "Lợi ích dự kiến"),
}

# --- fixed values: label translation, in order ------------------------------------------------

LOCALISED = (
    (r"\bChương\s+", "Chapter "), (r"\bCHUONG\s+", "Chapter "), (r"\bMục\s+", "Section "), (r"\bMUC\s+", "Section "),
    (r"\bPhần\s+", "Part "), (r"\bBài\s+", "Lesson "), (r"\bTrang\s+", "Page "), (r"\bNội dung\b", "Content"),
)

# --- fixed values: price lists (id, name, credits, price in VND) --------------------------------

CREDIT_PACKAGES = (
    (1, "Dùng thử", 10, 4000), (2, "Starter", 50, 15000), (3, "Standard", 100, 19000),
    (4, "Pro", 500, 85000), (5, "Academic", 1500, 220000),
)
SUBSCRIPTION_PACKAGES = (
    (10, "Sinh viên", 120, 29000), (11, "Giảng viên", 600, 99000), (12, "Khoa/Bộ môn", 2000, 289000),
)

# --- fixed values: experiment file columns --------------------------------------------------------

BLEU_COLUMNS = (
    "model", "model_short", "pdf", "bloom_level", "bloom_short", "source_chapter", "section_info",
    "bleu1_ans_chapter", "bleu2_ans_chapter", "bleu4_ans_chapter", "best_bleu_chapter", "best_bleu_score",
    "is_correct", "bleu4_ans_section", "bleu4_q_chapter", "answer_words", "question_words", "chapter_words",
    "section_words", "process_time_s", "total_points", "question", "answer",
)
JUDGE_COLUMNS_HEAD = ("idx", "pdf", "bloom_level", "bloom_short", "sys_bloom_int", "chapter")
JUDGE_COLUMNS_EACH = ("bloom_pred_{j}", "bloom_pred_name_{j}", "agree_{j}", "eval_time_{j}")
JUDGE_COLUMNS_TAIL = ("n_agree", "is_2llm", "is_3llm", "process_time_s", "question", "answer")

# How a text names its chapters and parts, in digits and as Roman numerals (up to the 20th).
CHAPTER_NUMBERS = (r"(?iu)Chương\s+(\d+)", r"(?iu)Chapter\s+(\d+)")
CHAPTER_NUMERALS = (r"(?iu)Phần\s+([IVX]+)",)
CHAPTER_ROMANS = 20

# Sentences that a structured draft leaves out, and the words that link its sentences.
DRAFT_METADATA_STARTS = (
    r"Câu\s+\d+", r"Bài\s+\d+", r"Ví dụ\s+\d+", r"Phần\s+\d+", r"Bài tập\s+\d+",
    r"\d+[.)]\s*[A-ZÀ-Ỹ][\p{L}\p{N}_]{0,15}\s*:",
)
DRAFT_CONNECTORS = ("Cụ thể,", "Ngoài ra,", "Bên cạnh đó,", "Đồng thời,", "Hơn nữa,", "Mặt khác,", "Thêm vào đó,")
DRAFT_LINKED_STARTS = ("Tuy nhiên", "Nhưng", "Và", "Hoặc", "Ngoài ra", "Bên cạnh", "Cụ thể", "Đồng thời", "Hơn nữa")

# Fixed value: quality of a usable reply before it is evaluated.
GENERATED_QUALITY = 0.75
