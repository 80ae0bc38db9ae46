"""Rule data: dictionaries, thresholds and weights used as default arguments.

Everything in this module is a fixed value: results depend on these words and
numbers, so they are kept together, in plain text and natural order. Callers
may pass their own lists of the same form.
"""

# --- fixed values: keyword tags (tag, needles); a tag fires when any needle occurs
KEYWORD_RULES = [
    ("search", ["search", "검색"]),
    ("list", ["list", "목록", "getall"]),
    ("detail", ["detail", "상세", "getone", "getbyid"]),
    ("create", ["create", "생성", "등록", "add"]),
    ("update", ["update", "수정", "edit"]),
    ("delete", ["delete", "삭제", "remove"]),
    ("pagination", ["pagination", "page-size", "currentpage"]),
    ("filter", ["filter", "필터"]),
    ("sort", ["sort", "정렬", "orderby"]),
    ("export", ["export", "내보내기", "download"]),
    ("import", ["import", "가져오기", "upload"]),
    ("modal", ["modal", "dialog", "팝업"]),
    ("form", ["form", "submit", "validate"]),
    ("table", ["table", "grid", "eltable"]),
    ("chart", ["chart", "graph", "차트"]),
    ("map", ["map", "지도", "location"]),
    ("grpc", ["grpc", "usegrpc"]),
    ("rest", ["rest", "axios", "fetch"]),
    ("graphql", ["graphql"]),
    ("auth", ["auth", "login", "로그인", "permission"]),
    ("file", ["fileupload", "filedownload", "파일"]),
    ("state-management", ["pinia", "vuex", "store"]),
    ("async", ["async", "await", "promise"]),
]
# --- fixed values: tags that need every needle
KEYWORD_RULES_ALL = [("error-handling", ["try", "catch"])]

# --- fixed values: keywords of a free-text request
REQUEST_RULES = [
    ("search", ["검색", "search", "찾"]),
    ("list", ["목록", "list", "조회"]),
    ("detail", ["상세", "detail", "보기"]),
    ("create", ["생성", "create", "등록", "추가"]),
    ("update", ["수정", "update", "편집", "변경"]),
    ("delete", ["삭제", "delete", "제거"]),
    ("pagination", ["페이지네이션", "pagination", "페이징"]),
    ("filter", ["필터", "filter"]),
    ("sort", ["정렬", "sort"]),
    ("modal", ["모달", "modal", "팝업", "dialog"]),
    ("form", ["폼", "form", "입력"]),
    ("table", ["테이블", "table", "표"]),
    ("grpc", ["grpc"]),
    ("rest", ["rest", "api"]),
]

# --- fixed values: hints read from TODO comments
TODO_RULES = [
    ("search", ["검색", "search"]),
    ("list", ["목록", "list"]),
    ("form", ["폼", "form"]),
    ("table", ["테이블", "table"]),
    ("modal", ["모달", "modal"]),
    ("pagination", ["페이지네이션", "pagination"]),
]

# --- fixed values: file role by directory name, first match wins
ROLE_DIRS = [
    ("page", ["pages"]),
    ("component", ["components"]),
    ("composable", ["composables"]),
    ("store", ["stores"]),
    ("api", ["api"]),
    ("util", ["utils", "helpers"]),
    ("layout", ["layouts"]),
    ("middleware", ["middleware"]),
    ("plugin", ["plugins"]),
]

# --- fixed values: role hint from a partial path; default "page"
ROLE_HINTS = [
    ("page", "pages/"),
    ("component", "components/"),
    ("composable", "composables/"),
    ("store", "stores/"),
]

# --- fixed values: path parts that are never entities
ENTITY_STOPLIST = ["Pages", "Components", "Composables", "Stores"]
ENTITY_NOUNS = [
    "User", "Product", "Order", "Category", "Brand",
    "Payment", "Cart", "Item", "Customer", "Admin",
]

# --- fixed values: REST calls recognised by substring (method, needles)
REST_CALLS = [
    ("rest.get", ["axios.get", "fetch("]),
    ("rest.post", ["axios.post"]),
    ("rest.put", ["axios.put"]),
    ("rest.delete", ["axios.delete"]),
]

# --- fixed values: corpus scan
SCAN_FOLDERS = [
    "pages", "components", "composables", "stores", "utils",
    "helpers", "api", "layouts", "middleware",
]
SCAN_EXTENSIONS = ["vue", "ts", "tsx", "js"]
PACKAGE_EXTENSIONS = ["vue", "ts", "tsx"]
PACKAGE_EXCLUDES = ["node_modules", "dist", ".git"]
PROJECT_MARKERS = ["nuxt", "nuxt3", "@nuxt/core"]

# --- fixed values: library detection patterns (library, regexes), in tie order
DESIGN_SYSTEM_PATTERNS = [
    ("element-plus", [r"El[A-Z]\w+", r"from ['\"]element-plus['\"]", r"element-plus"]),
    ("vuetify", [r"V[A-Z]\w+", r"from ['\"]vuetify['\"]", r"vuetify"]),
    ("quasar", [r"Q[A-Z]\w+", r"from ['\"]quasar['\"]", r"quasar"]),
    ("primevue", [r"Prime[A-Z]\w+", r"from ['\"]primevue['\"]", r"primevue"]),
    ("ant-design-vue", [r"A[A-Z]\w+", r"from ['\"]ant-design-vue['\"]", r"ant-design-vue"]),
    ("naive-ui", [r"N[A-Z]\w+", r"from ['\"]naive-ui['\"]", r"naive-ui"]),
]
UTILITY_PATTERNS = [
    ("vueuse", [r"use[A-Z]\w+", r"from ['\"]@vueuse/core['\"]",
                r"from ['\"]@vueuse/[^'\"]+['\"]", r"@vueuse"]),
    ("lodash", [r"_\.[a-z]+", r"from ['\"]lodash['\"]",
                r"import .+ from ['\"]lodash/[^'\"]+['\"]", r"lodash"]),
    ("date-fns", [r"from ['\"]date-fns['\"]", r"import \{[^}]*\} from ['\"]date-fns['\"]",
                  r"format\(", r"parseISO\(", r"addDays\(", r"subDays\(", r"differenceInDays\("]),
    ("axios", [r"axios\.", r"from ['\"]axios['\"]", r"import axios",
               r"\.get\(", r"\.post\(", r"\.put\(", r"\.delete\("]),
    ("dayjs", [r"dayjs\(", r"from ['\"]dayjs['\"]", r"import dayjs",
               r"\.format\(", r"\.add\(", r"\.subtract\("]),
    ("element-plus", [r"useFormItem", r"useLocale", r"useSize", r"from ['\"]element-plus['\"]"]),
    ("vuetify", [r"useDisplay", r"useTheme", r"useLayout", r"from ['\"]vuetify['\"]"]),
    ("quasar", [r"useQuasar", r"useDialogPluginComponent", r"from ['\"]quasar['\"]"]),
]

# --- fixed values: manifest dependencies
GRPC_PACKAGES = ["@grpc/grpc-js", "@grpc/proto-loader"]
OPENAPI_PACKAGES = ["@openapi", "swagger"]
REST_PACKAGES = ["axios", "fetch", "ky"]
KNOWN_DESIGN_SYSTEMS = [
    "element-plus", "vuetify", "quasar", "primevue", "ant-design-vue", "naive-ui",
]
KNOWN_UTILITIES = ["@vueuse/core", "vueuse", "lodash", "date-fns", "axios", "dayjs"]

# --- fixed values: item categories by name, first match wins
COMPONENT_CATEGORIES = [
    ("table", ["table", "grid", "list"]),
    ("button", ["button", "btn"]),
    ("input", ["input", "field", "text"]),
    ("modal", ["modal", "dialog"]),
    ("layout", ["layout", "container"]),
    ("select", ["select", "dropdown"]),
    ("card", ["card"]),
    ("form", ["form"]),
]
FUNCTION_CATEGORIES = [
    ("state", ["state", "storage", "store"]),
    ("event", ["mouse", "keyboard", "click"]),
    ("api", ["fetch", "api", "request"]),
    ("validation", ["validate", "validation"]),
    ("form", ["form"]),
    ("ui", ["alert", "toast", "notification", "loading"]),
    ("utility", ["format", "parse"]),
]
# a pattern of the file decides when the name does not (category, pattern)
FUNCTION_PATTERN_CATEGORIES = [
    ("state", "state-machine"), ("validation", "validation"), ("api", "api"),
]

# --- fixed values: ordinals
COMPLEXITY_LEVELS = ["trivial", "low", "medium", "high", "very-high"]
COMPLEXITY_BOUNDS = [("trivial", 10), ("low", 50), ("medium", 100), ("high", 200)]
TIERS = [("S", 90), ("A", 70), ("B", 50), ("C", 30)]
GRADES = [("excellent", 85), ("good", 70), ("fair", 50)]

# --- fixed values: quality dimensions and their weights (hundredths)
DIMENSIONS = [
    "structure", "apiConnection", "designSystem", "utilityUsage",
    "errorHandling", "typeUsage", "stateManagement", "performance",
]
WEIGHTS = {
    "structure": 15, "apiConnection": 15, "designSystem": 12, "utilityUsage": 10,
    "errorHandling": 15, "typeUsage": 13, "stateManagement": 10, "performance": 10,
}
EXCELLENT_FROM = 80
CRITICAL_DIMENSIONS = ["structure", "apiConnection", "errorHandling"]
SAVE_TOTAL, SAVE_CRITICAL, SAVE_MINIMUM = 70, 85, 40
SCORING_VERSION = "2.0.0"

# --- fixed values: single-score lookups and annotation-score lookups
SINGLE_COMPLEXITY = {"trivial": 20, "low": 40, "medium": 60, "high": 80, "very-high": 100}
SINGLE_ERROR = {"none": 0, "basic": 50, "comprehensive": 100}
SINGLE_TYPES = {"poor": 25, "basic": 50, "good": 75, "excellent": 100}
SINGLE_REUSE = {"low": 33, "medium": 66, "high": 100}
ANNOTATION_ERROR = {"none": 30, "basic": 60, "comprehensive": 90}
ANNOTATION_TYPES = {"poor": 30, "basic": 50, "good": 75, "excellent": 95}
ANNOTATION_REUSE = {"low": 40, "medium": 65, "high": 90}
ANNOTATION_API = {"grpc": 85, "rest": 70, "graphql": 75}

# Score terms, read by ``functions.scoring.points`` (the caller supplies the
# named features):
#   ("base", points)
#   ("pick", feature, {value: points})     exact value
#   ("flag", feature, points)              feature is true
#   ("under", feature, [(bound, points)])  first bound the feature is below
#   ("over", feature, [(bound, points)], each, cap)
#                                          first bound exceeded, else per-unit
#   ("from", feature, [(bound, points)], else_points)
#   ("per", feature, each, cap)            points per unit, capped
#   ("share", feature, points)             floor(ratio * points)
# A feature (field, [needles]) counts the values of the field that contain a needle.

# --- fixed values: file scores
FILE_SCORE_TERMS = {
    "structure": [
        ("base", 40), ("pick", "complexity", {"trivial": 25, "low": 20, "medium": 12}),
        ("under", "lines", [(100, 15), (200, 10), (300, 5)]),
        ("flag", "has_category", 10), ("per", "patterns", 3, 10)],
    "apiConnection": [
        ("base", 25), ("flag", "has_api", 40), ("pick", "api_type", {"grpc": 10}),
        ("per", "api_methods", 4, 20), ("pick", "category", {"api": 5})],
    "designSystem": [
        ("base", 30), ("flag", "has_design_system", 45),
        ("per", ("frameworks", ["element", "vuetify", "ui"]), 8, 15), ("pick", "category", {"page": 10})],
    "utilityUsage": [
        ("base", 25), ("flag", "has_utility_library", 45),
        ("per", ("dependencies", ["lodash", "date-fns", "vueuse"]), 10, 20),
        ("pick", "category", {"utility": 10, "composable": 10})],
    "errorHandling": [
        ("base", 30), ("pick", "error_handling", {"comprehensive": 45, "basic": 25}),
        ("per", ("patterns", ["error", "try-catch", "exception"]), 10, 25)],
    "typeUsage": [
        ("base", 40), ("pick", "type_definitions", {"excellent": 40, "good": 28, "basic": 15}),
        ("per", ("patterns", ["type", "interface", "generic"]), 7, 20)],
    "stateManagement": [
        ("base", 35), ("pick", "state_library", {"pinia": 30, "vuex": 20}),
        ("per", "composables_used", 4, 20), ("pick", "category", {"composable": 15})],
    "performance": [
        ("base", 45), ("pick", "complexity", {"trivial": 25, "low": 25, "medium": 15}),
        ("under", "lines", [(150, 15), (250, 10)]),
        ("per", ("patterns", ["lazy", "computed", "memo"]), 7, 15)],
}

# --- fixed values: project scores
PROJECT_SCORE_TERMS = {
    "structure": [
        ("base", 30), ("from", "categories", [(5, 25), (3, 20), (2, 15)], 5),
        ("pick", "complexity", {"trivial": 20, "low": 20, "medium": 15, "high": 8}),
        ("share", "excellent_ratio", 20), ("per", "patterns", 2, 10),
        ("per", ("excellent", ["구조", "structure", "분리", "네이밍"]), 3, 10)],
    "apiConnection": [
        ("base", 20), ("flag", "has_api", 25), ("pick", "api_type", {"grpc": 10, "mixed": 5}),
        ("per", "api_methods", 1.5, 15), ("per", ("patterns", ["api", "client", "interceptor"]), 5, 15),
        ("per", ("excellent", ["api", "grpc", "rest", "클라이언트"]), 4, 15)],
    "designSystem": [
        ("base", 30), ("flag", "has_design_system", 40),
        ("over", "components_used", [(10, 15), (5, 10), (0, 5)], 0, 0),
        ("per", ("dependencies", ["element-plus", "vuetify", "primevue", "naive-ui", "ant-design-vue"]), 10, 10),
        ("per", ("excellent", ["디자인", "design", "ui", "컴포넌트"]), 3, 10)],
    "utilityUsage": [
        ("base", 20), ("flag", "has_utility_library", 35),
        ("over", "composables_used", [(10, 20), (5, 15)], 2, 15),
        ("per", ("dependencies", ["lodash", "date-fns", "dayjs", "ramda", "vueuse"]), 8, 15),
        ("per", ("patterns", ["helper", "utility", "composable"]), 5, 15)],
    "errorHandling": [
        ("base", 25), ("share", "good_error_ratio", 35),
        ("per", ("patterns", ["error", "exception", "try-catch"]), 7, 20),
        ("per", ("excellent", ["error", "예외", "에러", "처리"]), 5, 20)],
    "typeUsage": [
        ("base", 35), ("share", "good_type_ratio", 35),
        ("per", ("patterns", ["type", "interface", "generic"]), 5, 15), ("share", "excellent_ratio", 15)],
    "stateManagement": [
        ("base", 30), ("pick", "state_library", {"pinia": 30, "vuex": 20}),
        ("over", "composables_used", [(8, 25), (4, 18)], 3, 15),
        ("per", ("patterns", ["state", "store", "pinia"]), 5, 15)],
    "performance": [
        ("base", 40), ("pick", "complexity", {"trivial": 25, "low": 20, "medium": 15, "high": 8}),
        ("per", ("patterns", ["lazy", "computed", "memo", "virtual", "cache"]), 6, 20),
        ("share", "excellent_ratio", 15)],
}



def feature_name(feature) -> str:
    """Column of a term's feature: its own name, or one for (field, [needles])."""
    return feature if isinstance(feature, str) else f"{feature[0]}_like_{feature[1][0]}"


#: Name of each counted feature -> (field, needles).
COUNTED = {feature_name(t[1]): t[1] for table in (FILE_SCORE_TERMS, PROJECT_SCORE_TERMS)
           for terms in table.values() for t in terms if t[0] != "base" and not isinstance(t[1], str)}


# --- fixed values: scores from raw text. A clause adds points when its test
# holds: "lines" (strictly between), "raw"/"low" substring of the text as is or
# lower-cased (any), "low_all" (all), "not_raw", "tag"; "per_*" add per item.
FALLBACK_TEXT_TERMS = {
    "structure": (40, [("lines", (50, 500), 20), ("raw", ["export default"], 10),
                       ("raw", ["<script setup"], 15)]),
    "apiConnection": (30, [("per_api_methods", None, 10), ("tag", "grpc", 15)]),
    "designSystem": (30, [("per_components_used", None, 5)]),
    "utilityUsage": (30, []),
    "errorHandling": (30, [("low_all", ["try", "catch"], 25)]),
    "typeUsage": (30, [("raw", ["interface ", "type "], 20)]),
    "stateManagement": (30, [("low", ["pinia", "usestore"], 25)]),
    "performance": (40, [("low", ["computed"], 15)]),
}
RICH_TEXT_TERMS = {
    "structure": (40, [("lines", (50, 500), 20), ("raw", ["export default"], 10),
                       ("raw", ["<script setup"], 15), ("raw", ["defineProps"], 5),
                       ("raw", ["defineEmits"], 5)]),
    "apiConnection": (30, [("per_api_methods", None, 10), ("tag", "grpc", 15),
                           ("tag", "rest", 10), ("low", ["usegrpc", "useapi"], 10)]),
    "designSystem": (30, [("per_components_used", None, 5), ("low", ["el-", "eltable"], 15),
                          ("low", ["scss", "style"], 10)]),
    "utilityUsage": (30, [("per_composables_used", None, 10), ("low", ["lodash", "datefns"], 15)]),
    "errorHandling": (30, [("tag", "error-handling", 30), ("low_all", ["try", "catch"], 20),
                           ("low", ["onerror", "error:"], 10)]),
    "typeUsage": (30, [("raw", ["interface ", "type "], 20), ("raw", [": string", ": number"], 15),
                       ("not_raw", [": any"], 10)]),
    "stateManagement": (30, [("tag", "state-management", 20), ("low", ["pinia", "usestore"], 25),
                             ("any_use_composable", None, 10)]),
    "performance": (40, [("tag", "async", 10), ("low", ["computed"], 15), ("low", ["lazy"], 15),
                         ("low", ["memo", "cache"], 10)]),
}

# --- fixed values: page categories that count as alike
CATEGORY_ALIASES = [
    ("list", ["list", "table", "grid", "index", "browse", "search-results"]),
    ("detail", ["detail", "view", "show", "single", "info"]),
    ("form", ["form", "create", "edit", "new", "update", "input"]),
    ("login", ["login", "signin", "auth", "authentication"]),
    ("dashboard", ["dashboard", "home", "overview", "summary", "main"]),
    ("settings", ["settings", "config", "preferences", "options"]),
    ("profile", ["profile", "account", "user", "mypage"]),
]
# --- fixed values: file categories that matter most per page category
FILE_PRIORITIES = {
    "list": ["page", "composable", "component", "api", "type"],
    "detail": ["page", "composable", "api", "component", "type"],
    "form": ["page", "composable", "component", "type", "utility"],
    "login": ["page", "composable", "api", "store", "type"],
    "dashboard": ["page", "component", "composable", "store", "api"],
}
DEFAULT_PRIORITIES = ["page", "composable", "component", "api"]
FILE_CATEGORY_ORDER = [
    "page", "component", "shared-component", "composable", "api",
    "type", "store", "utility", "service", "other",
]

# --- fixed values: guides
SCOPE_RANK = {"project": 4, "repo": 3, "org": 2, "global": 1}

# --- fixed values: gap to-dos, by rule (id, files, lines of code, priority); rule 5 counts its lines per method
GAP_RULES = {
    2: ("improve-error-handling", ["composables/**/*.ts", "server/api/**/*.ts"], 80, "high"),
    3: ("improve-type-definitions", ["types/**/*.ts", "composables/**/*.ts"], 50, "medium"),
    4: ("reduce-complexity", ["**/*.ts", "**/*.vue"], 100, "medium"),
    5: ("add-missing-api-methods", ["composables/useApi.ts", "server/api/**/*.ts"], 20, "low"),
    6: ("use-better-components", ["pages/**/*.vue", "components/**/*.vue"], 40, "low"),
}
# --- fixed values: files, lines of code and priority of a missing pattern
PATTERN_FILES = {
    "interceptor": "composables/useGrpcClient.ts",
    "error-recovery": "composables/useErrorHandler.ts",
    "singleton": "composables/useSingleton.ts",
    "factory": "composables/useFactory.ts",
    "repository": "composables/useRepository.ts",
    "service-layer": "services/index.ts",
    "dto": "types/dto.ts",
    "validation": "utils/validation.ts",
    "caching": "composables/useCache.ts",
    "retry-logic": "composables/useRetry.ts",
}
PATTERN_LOC = {
    "interceptor": 50, "error-recovery": 30, "singleton": 20, "factory": 40, "repository": 60,
    "service-layer": 80, "dto": 15, "validation": 35, "caching": 45, "retry-logic": 25,
}
PATTERN_PRIORITY = {
    "interceptor": "high", "error-recovery": "high", "validation": "high",
    "singleton": "medium", "factory": "medium", "repository": "medium", "caching": "medium",
}

# --- fixed values: words that point a request at a quality dimension
DIMENSION_WORDS = [
    ("apiConnection", [
        "api", "grpc", "rest", "fetch", "axios", "client", "server", "endpoint", "request", "response",
        "http", "websocket", "graphql", "backend", "service", "call", "invoke", "서버", "클라이언트", "요청", "응답",
        "호출", "통신", "연결", "엔드포인트",
    ]),
    ("errorHandling", [
        "error", "try", "catch", "throw", "exception", "validation", "validate", "check", "guard",
        "handle", "handler", "fallback", "retry", "recover", "fail", "success", "에러", "오류", "예외", "검증",
        "유효성", "처리", "실패", "성공", "재시도",
    ]),
    ("typeUsage", [
        "type", "interface", "generic", "typescript", "typing", "typed", "schema", "model", "dto",
        "class", "enum", "union", "intersection", "extends", "implements", "타입", "인터페이스", "제네릭", "스키마",
        "모델", "정의", "타입스크립트",
    ]),
    ("stateManagement", [
        "state", "store", "pinia", "vuex", "reactive", "ref", "computed", "watch", "action", "mutation",
        "getter", "setter", "persist", "hydrate", "subscribe", "dispatch", "상태", "스토어", "반응형", "액션",
        "뮤테이션", "구독", "저장", "관리",
    ]),
    ("designSystem", [
        "element", "el-", "ui", "component", "button", "input", "form", "table", "dialog", "modal",
        "layout", "style", "css", "scss", "tailwind", "theme", "icon", "card", "menu", "nav", "컴포넌트",
        "디자인", "레이아웃", "스타일", "테마", "아이콘", "UI", "화면",
    ]),
    ("structure", [
        "structure", "pattern", "architecture", "composable", "hook", "mixin", "plugin", "module",
        "organize", "layout", "hierarchy", "dependency", "inject", "provide", "factory", "singleton",
        "구조", "패턴", "아키텍처", "컴포저블", "훅", "모듈", "구성", "조직", "계층",
    ]),
    ("performance", [
        "performance", "optimize", "lazy", "cache", "memo", "virtual", "debounce", "throttle", "async",
        "await", "promise", "concurrent", "parallel", "batch", "chunk", "stream", "성능", "최적화", "캐시", "지연",
        "비동기", "병렬", "메모이제이션", "가상화",
    ]),
    ("utilityUsage", [
        "utility", "helper", "util", "common", "shared", "lib", "tool", "format", "parse", "convert",
        "transform", "sanitize", "escape", "encode", "decode", "serialize", "deserialize", "유틸", "헬퍼",
        "도우미", "공통", "변환", "포맷", "파싱", "직렬화",
    ]),
]
DEFAULT_DIMENSIONS = ["structure", "apiConnection"]

# --- fixed values: catalogue (library, kind, slot or category, names)
CATALOGUE = [
    ("element-plus", "component", {"table": ["ElTable"], "button": ["ElButton"], "input": ["ElInput"],
                                   "modal": ["ElDialog"], "layout": ["ElContainer"], "select": ["ElSelect"]}),
    ("vuetify", "component", {"table": ["VDataTable"], "button": ["VBtn"], "input": ["VTextField"],
                              "modal": ["VDialog"], "layout": ["VContainer"], "select": ["VSelect"],
                              "card": ["VCard"]}),
    ("quasar", "component", {"table": ["QTable"], "button": ["QBtn"], "input": ["QInput"],
                             "modal": ["QDialog"], "layout": ["QLayout"], "select": ["QSelect"]}),
    ("primevue", "component", {"table": ["DataTable"], "button": ["Button"], "input": ["InputText"],
                               "modal": ["Dialog"], "select": ["Dropdown"]}),
    ("ant-design-vue", "component", {"table": ["ATable"], "button": ["AButton"], "input": ["AInput"],
                                     "modal": ["AModal"], "layout": ["ALayout"], "select": ["ASelect"]}),
    ("naive-ui", "component", {"table": ["NDataTable"], "button": ["NButton"], "input": ["NInput"],
                               "modal": ["NModal"], "layout": ["NLayout"], "select": ["NSelect"],
                               "card": ["NCard"]}),
    ("vueuse", "function", {
        "state": ["useLocalStorage", "useSessionStorage", "useStorage"],
        "event": ["useMouse", "useMousePressed", "useDraggable"],
        "dom": ["useElementSize", "useElementVisibility", "useIntersectionObserver"],
        "animation": ["useTransition", "useInterval", "useTimeout"],
        "network": ["useFetch", "useAsyncState"],
        "utility": ["useDebounce", "useThrottle", "useClipboard"]}),
    ("lodash", "function", {"array": ["chunk", "uniq", "flatten"], "object": ["get", "set", "merge"],
                            "function": ["debounce", "throttle"], "string": ["camelCase", "kebabCase"]}),
    ("date-fns", "function", {"format": ["format"], "parse": ["parseISO"],
                              "manipulation": ["addDays", "subDays"],
                              "comparison": ["differenceInDays", "isAfter", "isBefore"]}),
    ("axios", "function", {"request": ["get", "post", "put", "delete"], "instance": ["create"]}),
    ("dayjs", "function", {"display": ["format"], "manipulation": ["add", "subtract"],
                           "comparison": ["diff", "isBefore", "isAfter"]}),
    ("element-plus", "function", {"form": ["useFormItem"], "style": ["useNamespace", "useZIndex"],
                                  "i18n": ["useLocale"], "props": ["useSize", "useDisabled"]}),
    ("vuetify", "function", {"responsive": ["useDisplay"], "theme": ["useTheme"],
                             "layout": ["useLayout"], "i18n": ["useLocale", "useRtl"],
                             "utility": ["useDate"]}),
    ("quasar", "function", {"core": ["useQuasar"], "dialog": ["useDialogPluginComponent"],
                            "meta": ["useMeta"], "form": ["useFormChild"]}),
]


def catalogue_rows(entries=CATALOGUE):
    """Flatten the catalogue to (library, kind, slot, name) rows."""
    return [
        (library, kind, slot, name)
        for library, kind, slots in entries
        for slot, names in slots.items()
        for name in names
    ]
