"""Words, packages, modules and directories that results depend on. Each is stated as text, in the order in which it was found."""

#: Words that carry no topic, for the keyword sets of descriptions and documents.
TOPIC_STOP_WORDS = tuple("""
a an and are as at be by do for from has have he in is it its of on or she that the their them then there these they this to was we were will
with you your use using used should must can may all each every no not only but if when where how what which who whom why so than too very just
about also been being both could did does doing done had having here into more most much own same some such would
""".split())

#: Words that a search leaves out.
SEARCH_STOP_WORDS = tuple("""
a an the and or but if of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all both each few more most other some such no nor not only own same so than too
very can will just should now also is are was were be been being have has had do does did would could may might shall as this that these those
it its they them their he she his her we our you your which who whom whose else every
""".split())

#: Domains of well-known packages, by language (TypeScript and JavaScript share theirs).
RUST_DOMAINS = {
    "HTTP": "reqwest hyper ureq curl attohttpc isahc tonic prost tower tower_http",
    "web framework": "actix_web axum warp rocket tide poem salvo ntex",
    "logging": "tracing tracing_subscriber tracing_log log env_logger pretty_env_logger slog flexi_logger",
    "testing": "proptest quickcheck rstest criterion test_case mockall wiremock assert_cmd assert_fs assert_matches pretty_assertions insta tempfile",
    "validation": "validator garde schemars",
    "serialization": "serde serde_json serde_yaml serde_toml toml bincode ciborium postcard rmp_serde ron csv",
    "database": "sqlx diesel sea_orm rusqlite tokio_postgres deadpool_postgres mongodb redis surrealdb",
    "CLI": "clap structopt argh pico_args bpaf",
    "async runtime": "tokio async_std smol futures async_trait rayon crossbeam crossbeam_channel",
    "crypto": "sha2 ring rustls openssl aes argon2 bcrypt hmac",
    "utilities": "uuid chrono time url bytes indexmap dashmap parking_lot once_cell lazy_static anyhow thiserror eyre itertools regex rand",
}
SCRIPT_DOMAINS = {
    "HTTP": "axios node_fetch got ky superagent undici socket_io socket_io_client socket.io socket.io_client graphql @apollo/client urql @tanstack/react_query react_query @tanstack/query_core swr",
    "web framework": "express fastify koa hapi next hono nest nuxt react vue angular svelte remix astro",
    "logging": "winston pino bunyan morgan log4js loglevel debug signale consola",
    "testing": "jest mocha vitest ava jasmine chai sinon cypress playwright testing_library @testing_library/react @testing_library/jest_dom supertest nock msw",
    "validation": "zod joi yup ajv class_validator superstruct io_ts valibot",
    "serialization": "protobufjs avro_js msgpack @msgpack/msgpack flatbuffers",
    "database": "prisma @prisma/client typeorm sequelize knex mongoose drizzle_orm pg mysql2 better_sqlite3 ioredis redis",
    "CLI": "commander yargs meow cac citty oclif inquirer",
    "utilities": "zustand redux @reduxjs/toolkit recoil jotai mobx xstate react_router react_router_dom @tanstack/react_router lodash ramda underscore immer date_fns dayjs moment luxon dotenv cross_env @sentry/react @sentry/nextjs @sentry/node",
}
PYTHON_DOMAINS = {
    "HTTP": "requests httpx aiohttp urllib3 httplib2 websockets websocket_client python_socketio grpcio grpcio_tools",
    "web framework": "flask django fastapi starlette tornado sanic pyramid bottle litestar blacksheep",
    "logging": "logging loguru structlog",
    "testing": "pytest unittest nose hypothesis mock unittest_mock faker factory_boy responses pytest_mock pytest_asyncio tox coverage pytest_cov",
    "validation": "pydantic marshmallow cerberus attrs voluptuous cattrs",
    "serialization": "json msgpack protobuf avro pickle pyyaml toml orjson ujson",
    "database": "sqlalchemy psycopg2 asyncpg pymongo redis peewee tortoise tortoise_orm databases sqlite3 alembic aioredis motor neo4j py2neo pinecone qdrant_client chromadb weaviate_client pymilvus elasticsearch opensearch_py",
    "CLI": "click argparse typer fire docopt rich",
    "async runtime": "asyncio trio anyio uvloop twisted celery dramatiq uvicorn gunicorn hypercorn daphne",
    "crypto": "cryptography pycryptodome hashlib passlib bcrypt itsdangerous jwt python_jose authlib",
    "utilities": "openai anthropic cohere google_generativeai google_genai langchain langchain_core langchain_openai langchain_anthropic langfuse litellm transformers sentence_transformers pandas numpy scipy polars pyarrow boto3 botocore aiobotocore google_cloud_storage azure_storage_blob jinja2 mako tenacity backoff retry paramiko fabric pillow pil cv2 opencv_python stripe sendgrid sqlglot alembic_utils",
}
#: Domains that a word of an unknown package's name speaks for; the first that fits counts.
TELLING_WORDS = (
    ("testing", "test mock"), ("logging", "log trace"), ("HTTP", "http web api rest"), ("database", "sql db orm"), ("CLI", "cli command arg"),
    ("serialization", "serial json yaml proto"), ("validation", "valid schema"),
)

#: Modules of the standard libraries.
PYTHON_STDLIB = tuple("""
__future__ abc argparse ast asyncio base64 bisect builtins calendar cmath codecs collections concurrent configparser contextlib copy csv ctypes
dataclasses datetime decimal difflib dis email enum errno fcntl fileinput fnmatch fractions functools gc getpass gettext glob gzip hashlib heapq
hmac html http importlib inspect io ipaddress itertools json keyword linecache locale logging lzma math mimetypes multiprocessing numbers
operator os pathlib platform pprint queue random re secrets select shelve shlex shutil signal site socket sqlite3 ssl stat string struct
subprocess sys syslog tempfile textwrap threading time timeit traceback types typing unicodedata unittest urllib uuid venv warnings weakref xml
zipfile zipimport zlib
""".split())
#: First components of Python imports that the parser takes for no package.
PYTHON_NO_PACKAGE = tuple("""
__future__ abc argparse array ast asyncio base64 bisect builtins bz2 cProfile collections compileall concurrent configparser contextlib copy csv
ctypes curses dataclasses datetime decimal difflib dis doctest email enum fnmatch fractions functools gc getopt getpass glob gzip hashlib heapq
hmac http importlib inspect io itertools json logging lzma math multiprocessing operator os pathlib pdb pickle pkgutil platform pprint profile
queue random re readline rlcompleter runpy secrets shelve shlex shutil signal socket sqlite3 ssl statistics string struct subprocess sys tarfile
tempfile textwrap threading time timeit traceback types typing typing_extensions unittest urllib uuid warnings weakref xml zipfile zipimport zlib
""".split())
NODE_BUILTINS = tuple("""
assert buffer child_process cluster console crypto dgram dns events fs http http2 https inspector module net os path perf_hooks process
querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib
""".split())
RUST_BUILTINS = tuple("std core alloc proc_macro test self super crate".split())
#: First components of Python modules that are a project's own.
PYTHON_OWN = tuple("src app lib tests test config".split())

#: Directories by kind.
TYPE_DIRS = tuple("models controllers services views handlers repositories middleware validators serializers schemas entities dtos mappers resolvers guards pipes interceptors decorators adapters providers factories strategies".split())
LAYER_DIRS = tuple("domain infrastructure application presentation core adapters ports usecases use_cases use-cases interfaces gateway gateways persistence delivery".split())
COMMON_DIRS = tuple("src lib tests test utils helpers types config scripts docs assets static public dist build bin examples benches fixtures".split())
TEST_DIRS = ("tests", "test", "__tests__")
CONFIG_DIRS = ("config", "configs", "configuration", ".config", "settings")
SOURCE_ROOTS = ("src", "lib", "app", "crates", "packages")
VENDORED_DIRS = (".git", ".tox", ".venv", ".pytest_cache", "__pycache__", "build", "dist", "node_modules", "target", "vendor", "venv")
#: Starts of the names of configuration files.
CONFIG_FILES = tuple("tsconfig jest.config vitest.config webpack.config vite.config rollup.config babel.config eslint .eslintrc prettier .prettierrc cargo.toml pyproject.toml setup.cfg setup.py tox.ini mypy.ini .flake8 ruff.toml package.json docker dockerfile makefile .env .gitignore .editorconfig".split())

#: Phrases after which a description names its choice, and words that are no choice.
CHOICE_PHRASES = ("use ", "prefer ", "canonical: ", "canonical ", "primary: ", "primary ", "library: ", "library ", "framework: ", "framework ", "pattern: ", "pattern ", "convention: ", "convention ", "standard: ", "standard ", "adopt ", "recommended: ", "recommended ")
NO_CHOICES = tuple("for the an and or in as to is it by of with from over vs all each every no not".split())

#: Files in which a module's own documentation stands.
ENTRY_POINTS = ("lib.rs", "mod.rs", "main.rs", "__init__.py", "index.ts", "index.js", "index.mjs")
