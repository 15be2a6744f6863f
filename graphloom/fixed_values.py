"""Lists, tables and limits that results depend on, in natural order."""

# -- scan ------------------------------------------------------------------------------
MAX_FILE_BYTES = 512 * 1024
MAX_NOTEBOOK_BYTES = 50 * 1024 * 1024
MAX_REPO_FILES = 2000
MAX_REPO_BYTES = 100 * 1024 * 1024
PRELOAD_FILE, PRELOAD_ALL = 100 * 1024, 10 * 1024 * 1024
IGNORED_DIRS = [
    ".git", ".svn", ".hg", "__pycache__", "node_modules", "venv", ".venv", "env", ".env", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "dist", "build", ".next", ".nuxt", ".output", "coverage", ".coverage", ".nyc_output", ".idea", ".vscode",
    ".DS_Store", "vendor", "bower_components", ".sass-cache", "tmp", ".tmp", "logs", ".eggs", "*.egg-info", ".gradle", ".cargo",
    "target", "Pods", ".terraform",
]
IGNORED_EXTENSIONS = [
    ".pyc", ".pyo", ".class", ".o", ".so", ".dll", ".dylib", ".exe", ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".log", ".lock",
    ".pid", ".swp", ".swo", ".DS_Store", ".ico", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".mp3", ".mp4", ".wav",
    ".avi", ".mov", ".zip", ".tar", ".gz", ".bz2", ".rar", ".7z", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map", ".min.js",
    ".min.css", ".pack", ".idx",
]
IGNORED_FILES = [
    ".DS_Store", "Thumbs.db", ".gitkeep", ".gitattributes", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock",
    "poetry.lock", "composer.lock", "Gemfile.lock", "Cargo.lock",
]
EXTENSION_LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java",
    ".kt": "Kotlin", ".go": "Go", ".rs": "Rust", ".c": "C", ".cpp": "C++", ".h": "C", ".hpp": "C++", ".cs": "C#", ".rb": "Ruby",
    ".php": "PHP", ".swift": "Swift", ".m": "Objective-C", ".r": "R", ".R": "R", ".scala": "Scala", ".dart": "Dart", ".lua": "Lua",
    ".sh": "Shell", ".bash": "Bash", ".zsh": "Zsh", ".ps1": "PowerShell", ".bat": "Batch", ".html": "HTML", ".htm": "HTML",
    ".css": "CSS", ".scss": "SCSS", ".sass": "Sass", ".less": "Less", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".xml": "XML", ".toml": "TOML", ".ini": "INI", ".cfg": "Config", ".conf": "Config", ".md": "Markdown",
    ".rst": "reStructuredText", ".txt": "Text", ".sql": "SQL", ".graphql": "GraphQL", ".proto": "Protocol Buffers",
    ".dockerfile": "Dockerfile", ".tf": "Terraform", ".vue": "Vue", ".svelte": "Svelte", ".astro": "Astro", ".ex": "Elixir",
    ".exs": "Elixir", ".erl": "Erlang", ".hs": "Haskell", ".ml": "OCaml", ".jl": "Julia", ".pl": "Perl", ".pm": "Perl",
    ".clj": "Clojure", ".ipynb": "Jupyter Notebook", ".mjs": "JavaScript", ".cjs": "JavaScript", ".mdx": "MDX", ".jsonc": "JSON",
    ".csv": "Data", ".tsv": "Data", ".env": "Dotenv", ".gradle": "Gradle", ".cmake": "CMake",
}
FILENAME_LANGUAGES = {
    "Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake", "Rakefile": "Ruby", "Gemfile": "Ruby",
    "Vagrantfile": "Ruby", "Procfile": "Procfile", ".gitignore": "Git Config", "docker-compose.yml": "YAML",
    "docker-compose.yaml": "YAML", "requirements.txt": "Python", "setup.py": "Python", "setup.cfg": "Python",
    "pyproject.toml": "Python", "package.json": "JSON", "tsconfig.json": "JSON", "webpack.config.js": "JavaScript",
    "vite.config.js": "JavaScript", "vite.config.ts": "TypeScript", "next.config.js": "JavaScript",
    "tailwind.config.js": "JavaScript", "Cargo.toml": "TOML", "go.mod": "Go", "go.sum": "Go", "build.gradle": "Gradle",
    "pom.xml": "Maven",
}

SECRET_NAMES = [".env", ".env.local", ".env.production", ".env.development", ".env.test", ".env.example", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SECRET_SUFFIXES = [".pem", ".key", ".pfx", ".p12"]

# -- layers and roles --------------------------------------------------------------------
#: path keywords of layers; the first layer with a keyword inside the lower-case path holds
LAYER_KEYWORDS = [
    ("routes", ["route", "controller", "api", "endpoint", "view", "screen", "page"]),
    ("models", ["model", "schema", "entity", "type", "interface", "dto"]),
    ("services", ["service", "logic", "handler", "pipeline", "rag", "middleware", "orchestrat"]),
    ("database", ["db", "database", "repo", "migration", "prisma", "drizzle", "sequelize"]),
    ("utils", ["util", "helper", "lib", "common", "shared", "tool", "script", "cli"]),
    ("config", ["config", "setting", "constant", "env"]),
    ("frontend", ["component", "layout", "ui", "css", "style", "theme", "hook", "composable", "store", "redux", "zustand", "state", "asset", "static", "public"]),
    ("tests", ["test", "spec", "__test__", "__spec__"]),
]
ROLE_LAYERS = {
    "entry_point": "routes", "router": "routes", "orchestrator": "services", "core_module": "services", "ml_pipeline": "services",
    "ml_training": "services", "ml_model": "models", "type_definition": "models", "data": "database", "shared_utility": "utils",
    "internal_helper": "utils", "config": "config", "test": "tests", "barrel": "other", "leaf": "other", "build": "other",
    "documentation": "other",
}
ROLE_STAGES = {
    "entry_point": (0, "io"), "router": (1, "io"), "orchestrator": (2, "process"), "core_module": (2, "process"),
    "ml_training": (2, "process"), "ml_pipeline": (2, "process"), "shared_utility": (3, "transform"),
    "internal_helper": (3, "transform"), "ml_model": (4, "data_store"), "type_definition": (4, "data_store"),
    "config": (4, "data_store"), "data": (4, "data_store"),
}
STAGE_SHAPES = {"process": "rounded_rect", "data_store": "cylinder", "io": "parallelogram", "transform": "hexagon"}
ENTRY_NAMES = [
    "main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "server.py", "run.py", "cli.py", "__main__.py", "index.js", "index.ts",
    "index.mjs", "main.js", "main.ts", "app.js", "app.ts", "server.js", "server.ts", "main.go", "cmd.go", "Main.java", "App.java",
    "Application.java", "main.rs", "lib.rs", "app.rb", "config.ru", "Rakefile", "index.php", "artisan", "main.c", "main.cpp",
]
#: for roles: as above without lib.rs and Rakefile
ROLE_ENTRY_NAMES = [n for n in ENTRY_NAMES if n not in ("lib.rs", "Rakefile")]
PROJECT_FILES = [
    "package.json", "setup.py", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Makefile", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml",
]
CONFIG_NAMES = [
    "settings.py", "config.py", "conf.py", "constants.py", "config.js", "config.ts", "constants.js", "constants.ts", ".env",
    ".env.example", ".env.local", "next.config.js", "next.config.mjs", "nuxt.config.js", "nuxt.config.ts", "vite.config.js",
    "vite.config.ts", "webpack.config.js", "webpack.config.ts", "tailwind.config.js", "tailwind.config.ts", "tsconfig.json",
    "jsconfig.json", "babel.config.js", ".babelrc", "eslint.config.js", ".eslintrc.js", ".eslintrc.json", "jest.config.js",
    "jest.config.ts", ".prettierrc", ".prettierrc.js", "pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml", "go.mod", "pom.xml",
    "build.gradle", "build.gradle.kts",
]
BUILD_NAMES = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", "CMakeLists.txt", "Rakefile", "Procfile", "Vagrantfile", "Jenkinsfile", ".travis.yml", ".circleci"]
DOC_NAMES = [
    "README.md", "README.rst", "README.txt", "README", "CHANGELOG.md", "CHANGELOG.rst", "HISTORY.md", "CONTRIBUTING.md",
    "CONTRIBUTING.rst", "LICENSE", "LICENSE.md", "LICENSE.txt", "CODE_OF_CONDUCT.md", "AUTHORS", "AUTHORS.md",
]
DOC_DIRS = ["docs", "doc", "documentation", "wiki"]
CI_PARTS = [".github/workflows", ".gitlab-ci", ".circleci", "jenkins", ".travis", "azure-pipelines", ".buildkite"]
TEST_PATTERNS = [r"test[_s]?[\\/]", r"__tests__[\\/]", r"spec[\\/]", r"_test\.py$", r"_spec\.py$", r"^test_", r"\.test\.", r"\.spec\.", r"_test\.go$", r"Test\.java$"]
TYPE_PATTERNS = [r"types?\.", r"interfaces?\.", r"models?\.", r"schemas?\.", r"entities?\.", r"dto\.", r"\.d\.ts$"]
DATA_PATTERNS = [r"migrations?[\\/]", r"seeds?[\\/]", r"fixtures?[\\/]", r"data[\\/]", r"\.sql$"]
SOURCE_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".java", ".kt", ".rs", ".rb", ".php", ".c", ".cpp", ".h", ".hpp",
    ".cs", ".swift", ".scala", ".dart", ".ex", ".exs", ".vue", ".svelte", ".ipynb",
]
TEMPLATE_EXTENSIONS = [".html", ".vue", ".svelte", ".ejs", ".hbs", ".pug", ".jinja", ".jinja2"]
ROUTE_PATTERNS = [r"@app\.\w+\(", r"@router\.\w+\(", r"router\.\w+\(", r"@Get\(|@Post\(|@Put\(", r"path\s*\(", r"urlpatterns"]
FRAMEWORK_PATTERNS = {
    "pytorch": r"\bimport\s+torch\b|\bfrom\s+torch\b|\bimport\s+torchvision\b",
    "tensorflow": r"\bimport\s+tensorflow\b|\bfrom\s+tensorflow\b",
    "keras": r"\bimport\s+keras\b|\bfrom\s+keras\b|\bfrom\s+tensorflow\.keras\b",
    "jax": r"\bimport\s+jax\b|\bfrom\s+jax\b|\bimport\s+flax\b|\bfrom\s+flax\b",
    "sklearn": r"\bimport\s+sklearn\b|\bfrom\s+sklearn\b",
}
FRAMEWORK_WORDS = {"pytorch": ["torch"], "tensorflow": ["tensorflow"], "keras": ["keras"], "jax": ["jax", "flax"], "sklearn": ["sklearn"]}
MODEL_PATTERN = r"class\s+\w+\s*\(\s*(?:nn\.Module|keras\.Model|tf\.keras\.Model)\s*\)|(?:nn\.Sequential|keras\.Sequential|tf\.keras\.Sequential)\s*\(|(?:nn\.(?:Conv|Linear|LSTM|GRU|BatchNorm|Dropout|Embedding|Transformer)|layers\.(?:Dense|Conv))"
TRAINING_PATTERN = r"(?:\.backward\(\)|optimizer\.(?:step|zero_grad)|model\.fit\(|model\.train\(\))"
PIPELINE_PATTERN = r"(?:DataLoader|Dataset|transforms\.(?:Compose|Normalize)|tf\.data)"
SELECTION_ROLES = {
    "entry_point": 10, "core_module": 9, "orchestrator": 8, "shared_utility": 7, "config": 7, "router": 6, "type_definition": 4,
    "internal_helper": 3, "barrel": 2, "documentation": 2, "build": 1, "data": 1, "leaf": 0, "test": 0,
}
FLAG_ORDER = ["orphan", "in_cycle", "hub", "entry_point", "god_file"]
HUB_MOST, HUB_SHARE = 10, 0.05
GOD_MOST, GOD_SHARE, GOD_BYTES_PER_LINE = 40_000, 0.02, 40
QUESTIONS = {
    "orphan": "Nothing imports this file. Why is it in the repo?",
    "in_cycle": "This and {other} import each other — why, and would you fix it?",
    "hub": "A lot depends on this. What breaks if you change it?",
    "entry_point": "Walk me through what happens when a request arrives.",
    "god_file": "This file is ~{lines} lines. How would you split it?",
}
TECHNOLOGY_RULES = [
    ("supabase", "Supabase"),
    ("@supabase/", "Supabase"),
    ("pymilvus", "Milvus"),
    ("milvus", "Milvus"),
    ("zilliz", "Zilliz / Milvus"),
    ("google.genai", "Google Gemini"),
    ("google", "Google OAuth"),
    ("redis", "Redis"),
]

# -- limits -------------------------------------------------------------------------------
CENTRAL_TOP = 30
SELECT_FILES, SELECT_TOKENS = 30, 80_000
TOUR_TOP = 15
TREEMAP_FILES = 250
MINDMAP_FILES, MINDMAP_NAMES = 50, 10
GRAPH_NODES = 100
LABEL_SWEEPS = 20
BFS_DEPTH, BFS_NODES, BFS_STARTS = 3, 50, 5
FALLBACK_SHARE = 0.70
STANDALONE_FROM = 3
USER_QUOTA_TOKENS, GLOBAL_QUOTA_USD = 200_000, 5.0
BREAKER_FAILURES, BREAKER_SECONDS = 5, 60
BREAKER_QUIET_SECONDS, SESSION_SECONDS = 24 * 3600, 24 * 3600
KEEPALIVE_SECONDS = 15
RETRY_WAITS = [5, 15, 30]
STAGE_BUCKETS = [0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
CHUNK_CHARS, CHUNK_OVERLAP = 1500, 200
TOP_K, TOP_K_TECHNICAL = 5, 8
EXCLUDED_LAYERS = ["frontend", "test"]
TECHNICAL_KEYWORDS = [
    "architecture", "rag", "pipeline", "embedding", "vector", "backend", "api", "database", "engineer", "technical", "system design",
    "infrastructure", "deployment", "security", "authentication", "middleware", "service", "model", "schema", "algorithm", "indexer",
    "orchestrator", "provider", "llm", "chunking", "retrieval", "prompt",
]
ARCHITECTURE_FROM, FULL_FROM, FULL_SHARE = 10, 30, 0.5

# -- aliases ------------------------------------------------------------------------------
NODE_TYPES = {
    "func": "function", "fn": "function", "method": "function", "function_declaration": "function", "lambda": "function",
    "interface": "component", "struct": "component", "type": "component", "mod": "module", "pkg": "module", "package": "module",
    "lib": "module", "file": "file", "container": "services", "deployment": "services", "pod": "services", "service": "services",
    "controller": "routes", "router": "routes", "endpoint": "routes", "route": "routes", "api": "routes", "model": "models",
    "schema": "models", "entity": "models", "db": "database", "table": "database", "helper": "utils", "util": "utils",
    "utility": "utils", "helpers": "utils", "cfg": "config", "setting": "config", "env": "config", "test": "tests", "spec": "tests",
    "test_file": "tests", "class": "class", "method_definition": "method", "external": "external", "unknown": "other",
}
EDGE_TYPES = {
    "extends": "inherits", "implements": "inherits", "invokes": "calls", "invoke": "calls", "uses": "calls", "calls": "calls",
    "import": "imports", "imports_from": "imports", "requires": "imports", "depends_on": "imports", "relates_to": "related",
    "related_to": "related", "publishes_to": "publishes", "subscribes_to": "subscribes",
}
ROLES = {
    "orchestrator": "orchestrator", "coordinator": "orchestrator", "controller": "orchestrator", "router": "orchestrator",
    "service": "service_layer", "service_layer": "service_layer", "utility": "utility", "util": "utility", "helper": "utility",
    "repository": "repository", "repo": "repository", "data_access": "repository", "middleware": "middleware", "config": "config",
    "test": "test", "type_definition": "type_definition", "documentation": "documentation", "leaf": "leaf", "build": "build",
    "barrel": "barrel", "data": "data", "shared_utility": "shared_utility", "internal_helper": "internal_helper",
    "entry_point": "entry_point", "core_module": "core_module",
}
COMPLEXITY = {
    "simple": 1, "trivial": 1, "easy": 1, "low": 1, "moderate": 3, "medium": 3, "standard": 3, "intermediate": 3, "med": 3,
    "complex": 5, "advanced": 5, "hard": 5, "sophisticated": 5, "high": 5, "very complex": 7, "highly complex": 7,
    "extremely complex": 9,
}

# -- views ------------------------------------------------------------------------------
FLOW_NODES, FLOW_EDGES = 15, 25
STAGE_TECHNOLOGIES = 6
FLOW_DATA = ["http", "db", "event", "file", "internal"]
OLD_KINDS = {"start": "io", "end": "io", "action": "process", "decision": "transform", "transform": "transform", "data_store": "data_store"}
LANE_ORDER = ["routes", "services", "models", "database", "utils", "config", "tests", "frontend", "module", "other"]
CARD_CHROME, CARD_ROW = 56, 16
BOX_PADDING, BOX_HEADER = 16, 40
FOLDER_KINDS = {
    "routes": "route|api|endpoint|handler", "models": "model|schema|entity", "services": "service|provider",
    "database": "db|database|migration", "utils": "util|helper|lib|common", "config": "config|setting|env", "tests": "test|spec",
    "component": "component|widget|ui|view|page",
}
#: source files but notebooks
EXPLAINED_EXTENSIONS = [e for e in SOURCE_EXTENSIONS if e != ".ipynb"]
SELECTED_CHARS, PROMPT_ITEMS, TILES = 12_000, 10, 80
CLONE_HOURS, SAME_FILE_HITS = 24, 3
NN_FRAMEWORKS = [
    "torch", "torchvision", "tensorflow", "tf", "keras", "jax", "flax", "transformers", "timm", "lightning", "pytorch_lightning",
    "fastai", "diffusers", "sentence_transformers",
]
NN_ROLES = ["ml_model", "ml_training", "ml_pipeline"]

# -- networks -----------------------------------------------------------------------------
NN_CONV = ["Conv1d", "Conv2d", "Conv3d", "ConvTranspose1d", "ConvTranspose2d", "ConvTranspose3d", "Conv1D", "Conv2D", "Conv3D"]
NN_POOL = [
    "MaxPool1d", "MaxPool2d", "MaxPool3d", "AvgPool1d", "AvgPool2d", "AvgPool3d", "MaxPooling1D", "MaxPooling2D", "MaxPooling3D",
    "AveragePooling1D", "AveragePooling2D", "AveragePooling3D",
]
NN_GLOBAL_POOL = [
    "AdaptiveAvgPool1d", "AdaptiveAvgPool2d", "AdaptiveMaxPool2d", "GlobalAveragePooling1D", "GlobalAveragePooling2D",
    "GlobalMaxPooling1D", "GlobalMaxPooling2D",
]
NN_FLAT = ["Flatten", "Linear", "LazyLinear", "Dense"]
NN_KEEP_WIDTH = [
    "ReLU", "LeakyReLU", "GELU", "SiLU", "ELU", "Tanh", "Sigmoid", "Softmax", "Dropout", "Dropout1d", "Dropout2d", "Dropout3d",
    "BatchNorm1d", "BatchNorm2d", "BatchNorm3d", "LayerNorm", "GroupNorm", "MaxPool1d", "MaxPool2d", "MaxPool3d", "AvgPool1d",
    "AvgPool2d", "AvgPool3d", "AdaptiveAvgPool1d", "AdaptiveAvgPool2d", "AdaptiveMaxPool2d", "Activation", "Flatten", "Identity",
]
NN_GROUPS = {
    "convolution": NN_CONV,
    "pooling": [*NN_POOL, *NN_GLOBAL_POOL],
    "dense": ["Linear", "Dense", "LazyLinear"],
    "normalization": ["BatchNorm1d", "BatchNorm2d", "BatchNorm3d", "LayerNorm", "GroupNorm", "InstanceNorm1d", "InstanceNorm2d", "BatchNormalization"],
    "activation": ["ReLU", "LeakyReLU", "PReLU", "GELU", "ELU", "Sigmoid", "Tanh", "Softmax", "LogSoftmax", "SiLU", "Mish", "Hardswish", "Activation"],
    "dropout": ["Dropout", "Dropout2d", "Dropout3d", "AlphaDropout", "SpatialDropout1D", "SpatialDropout2D"],
    "recurrent": ["LSTM", "GRU", "RNN", "LSTMCell", "GRUCell", "SimpleRNN", "Bidirectional"],
    "attention": ["MultiheadAttention", "TransformerEncoder", "TransformerDecoder", "TransformerEncoderLayer", "TransformerDecoderLayer", "Transformer"],
    "embedding": ["Embedding", "EmbeddingBag"],
    "other": ["Flatten", "Unflatten", "Reshape", "Lambda", "Input", "Concatenate", "Add"],
}
NN_CATEGORIES = {kind: group for group, kinds in NN_GROUPS.items() for kind in kinds}
NN_BASES = ["nn.Module", "torch.nn.Module", "keras.Model", "tf.keras.Model", "keras.models.Model", "tensorflow.keras.Model", "tensorflow.keras.models.Model", "flax.linen.Module", "flax.nnx.Module"]
NN_PREFIXES = ["nn.", "torch.nn.", "layers.", "keras.layers.", "tf.keras.layers.", "tensorflow.keras.layers.", "flax.linen.", "flax.nnx."]
NN_CONTAINERS = ["ModuleList", "Sequential", "ModuleDict"]
NN_WRAPPERS = ["Bidirectional", "TimeDistributed"]
NN_PRETRAINED = ["torchvision.models.", "keras.applications.", "tf.keras.applications.", "tensorflow.keras.applications."]
NN_NOT_MODELS = ["tokenizer", "tokenizerfast", "processor", "featureextractor", "imageprocessor", "extractor", "config"]
NN_LOOSE, NN_MOST_REPEATS = 2, 64
NN_LEAST_EXTENT = 1 / 64
#: height from and to, thickness from and to; height where nothing is known; a head's share of the height; depth
NN_BLOCK = (26.0, 110.0, 6.0, 46.0)
NN_UNKNOWN_HEIGHT, NN_HEAD, NN_DEPTH = 40.0, 0.12, 14.0

# N14, fixed values: recession of depth, sizes in points of the tallest face, gaps, margins, least faces and depth, greatest depth by height, step of a repeated copy, copies shown
FIGURE_ANGLE, FIGURE_DEPTH = 30.0, 0.5
FIGURE_HEIGHT, FIGURE_GAP, FIGURE_LEFT, FIGURE_TOP = 300.0, 104.0, 64.0, 54.0
FIGURE_LEAST_HEIGHT, FIGURE_LEAST_WIDTH, FIGURE_LEAST_DEPTH, FIGURE_MOST_DEPTH = 118.0, 46.0, 30.0, 0.62
FIGURE_STEP, FIGURE_COPIES = 22.0, 3
FIGURE_UNITS = ["units", "filters", "out_channels", "out_features", "hidden_size", "embedding_dim", "num_embeddings"]
# by what is known of a layer: bounds of height, of depth (one number where it is the same for all) and of width
FIGURE_SIZES = {
    "map": ((10, 80), (8, 60), (4, 34)), "matrix": ((10, 80), 16, (4, 34)), "row": ((12, 80), 14, 8),
    "units": ((26, 80), 16, (5, 26)), "count": ((24, 62), 15, (5, 20)), "none": (22, 13, 5),
}
