"""Code scans as Column expressions over masked texts (see ``lexer``): capabilities and imports, by rule tables of names.

``bare`` is a source without comments and insides of strings, ``code`` one without comments, whose strings are there but
cannot look like code. A pattern that needs quotes is looked for in ``code``, any other in ``bare``; so a call that stands in
a comment or a string is no call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHELL, EVAL, BASE64, NET, ENV, FS, RAW_IP, HOOK = "shell-spawn", "dynamic-eval", "base64-decode", "net-egress", "env-read", "fs-write-outside-root", "raw-ip-literal", "install-hook-exec"


def _f(names: str) -> str:
    """A free call of one of the names."""
    return rf"(?<![.\w$:])(?<!->)(?:{names})\s*[!?]?\("


def _m(owner: str, names: str, sep: str = r"\s*(?:\.|::|->)\s*") -> str:
    """A member call on an owner."""
    return rf"(?<![\w$])(?:{owner}){sep}(?:{names})\s*\(?"


def _d(names: str) -> str:
    """A method call on anything."""
    return rf"(?:\.|->)\s*(?:{names})\s*\("


def _n(names: str) -> str:
    """A constructor."""
    return rf"\bnew\s+(?:{names})\b"


_OPENS = r"""\(\s*[^()\n]*,\s*(?:mode\s*=\s*)?['"](?:[wax][btr+]?|[btr+][wax])['"]"""
_C_SHELL = "system|popen|execl|execlp|execle|execv|execvp|execvpe|execve|fork|vfork|posix_spawn|posix_spawnp"
_C = {
    SHELL: [_f(_C_SHELL)], EVAL: [_f("dlopen|dlsym|LoadLibrary|LoadLibraryA|LoadLibraryW|GetProcAddress")], ENV: [],
    NET: [_f("socket|connect|gethostbyname|getaddrinfo|curl_easy_perform|curl_easy_init")], FS: [_f("fopen|open|open64|creat|fwrite|rename|remove|unlink|mkdir")],
}
_RUBY = {
    SHELL: [_f("system|exec|spawn|fork"), _m("Kernel|Process", "system|exec|spawn"), _m("IO", "popen|popen2|popen3|popen2e"), _m("Open3", r"\w+"), _m("PTY", "spawn|getpty"), r"`[^`\n]+`"],
    EVAL: [_f("eval|instance_eval|class_eval|module_eval|binding_eval|send|public_send|__send__"), _m("Kernel|Module|Object|BasicObject", "eval|instance_eval|class_eval|module_eval")],
    BASE64: [_m("Base64", "decode64|urlsafe_decode64|strict_decode64")],
    NET: [_m(r"Net::HTTPS?", r"\w+"), _m("URI", "open|read|parse"), r"""(?<![.\w])open\s*\(?\s*['"]https?://""", _m("HTTParty|RestClient|Faraday|Excon|Typhoeus", "get|post|put|delete|patch|head|new|request"), _m("TCPSocket|UDPSocket|Socket|UNIXSocket", "new|open")],
    FS: [r"\bFile\.open" + _OPENS, _m("File|IO", "write|binwrite|append"), _m("FileUtils", "cp|mv|cp_r|mv_r|copy|copy_file|copy_entry|install")], ENV: [],
}
# The names that give a language's capabilities.
CAPABILITY_RULES: dict[str, dict[str, list[str]]] = {
    "js": {
        SHELL: [r"""require\(\s*['"](?:node:)?child_process['"]\s*\)""", r"""from\s+['"](?:node:)?child_process['"]""", _d("execSync|execFile|execFileSync|spawn|spawnSync|fork"), _f("execSync|execFileSync|spawnSync")],
        EVAL: [_f("eval|Function"), _n("Function")], BASE64: [_f("atob"), r"""\bBuffer\s*\.\s*from\s*\([^)]*['"]base64['"]"""],
        NET: [r"""require\(\s*['"](?:node:)?(?:http|https|net|dgram|tls)['"]\s*\)""", r"""from\s+['"](?:node:)?(?:http|https|net|dgram|tls)['"]""", _f("fetch"), _n("XMLHttpRequest")],
        ENV: [r"\bprocess\s*\.\s*env\b"],
        FS: [r"""require\(\s*['"](?:node:)?(?:fs|fs/promises|graceful-fs)['"]\s*\)""", _d("writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream"), _f("writeFileSync|appendFileSync")],
    },
    "py": {
        SHELL: [_m("subprocess", "run|call|Popen|check_call|check_output|getoutput|getstatusoutput"), _m("os", "system|popen|spawn[lvep]+|exec[lvep]+"), _m("commands", "getoutput|getstatusoutput"), _m("pty", "spawn"), _f("Popen|check_output|check_call")],
        EVAL: [_f("eval|exec|compile|__import__")], BASE64: [_m("base64|codecs|binascii", "b64decode|standard_b64decode|urlsafe_b64decode|decode|a2b_base64|a2b_hex|unhexlify")],
        NET: [_m("urllib|urllib2|requests|httpx|aiohttp", "urlopen|get|post|put|delete|patch|request|head|options"), _m(r"urllib\.request", "urlopen|Request|build_opener|install_opener"), _m("socket", "socket|create_connection|create_server"), _m(r"http\.client", "HTTPConnection|HTTPSConnection")],
        FS: [r"(?<![.\w])open\s*" + _OPENS, _d("write_text|write_bytes"), _m("shutil", "copy|copy2|copyfile|copyfileobj|copytree|move")], ENV: [],
    },
    "ruby": _RUBY, "cocoapods": _RUBY | {SHELL: [*_RUBY[SHELL], r"\bprepare_command\b", r"\bscript_phase\b"]},
    "go": {
        SHELL: [_m("exec", "Command|CommandContext|LookPath"), _m("syscall", "Exec|ForkExec|StartProcess"), _m("os", "StartProcess")], EVAL: [_m("plugin", "Open")], BASE64: [_m(r"base64(?:\.\w+)?|hex", "DecodeString|Decode|DecodedLen")],
        NET: [_m("http", "Get|Post|PostForm|Head|NewRequest|NewRequestWithContext"), _m("net", "Dial|DialTimeout|DialContext|Listen|ListenPacket"), _m("tls", "Dial|DialWithDialer")],
        FS: [_m("os", "WriteFile|Create|OpenFile|Mkdir|MkdirAll|Rename|Symlink|Link"), _m("ioutil", "WriteFile")], ENV: [],
    },
    "php": {
        SHELL: [_f("exec|shell_exec|system|passthru|popen|proc_open|pcntl_exec|escapeshellcmd|escapeshellarg"), r"`[^`\n]+`"], EVAL: [_f("eval|assert|create_function|call_user_func|call_user_func_array")],
        BASE64: [_f("base64_decode|gzinflate|gzuncompress|gzdecode|str_rot13|hex2bin|convert_uudecode")],
        NET: [r"""(?<![.\w>:])(?:file_get_contents|fopen|readfile|file)\s*\(\s*['"]https?://""", _f("curl_init|curl_exec|curl_multi_exec|fsockopen|pfsockopen|socket_create|socket_connect|stream_socket_client|stream_socket_server")],
        FS: [_f("file_put_contents|fwrite|fputs|fputcsv|copy|rename|symlink|link|move_uploaded_file|chmod|chown|chgrp|touch|mkdir"), r"(?<![.\w>:])fopen\s*" + _OPENS], ENV: [],
    },
    "rust": {
        SHELL: [r"(?:\b|::)Command::new\s*\(", r"::CommandExt::exec\s*\(", r"\b(?:libc|nix::unistd)::(?:execv|execve|execvp|execvpe|exec|system|popen)\s*\("], EVAL: [r"\bLibrary::new\s*\(", r"\blibc::(?:dlopen|dlsym)\s*\("],
        BASE64: [r"\bbase64::(?:decode|decode_config|decode_engine)\s*\(", _d("decode")],
        NET: [r"\b(?:reqwest|ureq|attohttpc|surf|isahc)(?:::[a-z_]+)?::(?:get|post|put|delete|patch|head)\s*\(", r"\b(?:reqwest|hyper|isahc)(?:::[a-z_]+)?::Client::(?:new|builder)\s*\(", r"\bTcpStream::connect\s*\("],
        FS: [r"\bfs::(?:write|copy|rename|hard_link)\s*\(", r"\bFile::create\s*\("], ENV: [],
    },
    "java": {
        SHELL: [_d("exec"), _n("ProcessBuilder"), _m("Runtime", "getRuntime")], EVAL: [_m("Class", "forName"), _d("loadClass|defineClass|getSystemClassLoader|invoke|eval")],
        BASE64: [_m("Base64", "getDecoder|getMimeDecoder|getUrlDecoder"), _m("DatatypeConverter", "parseBase64Binary")],
        NET: [_d("openConnection|openStream|send|sendAsync|newCall|enqueue"), _n("Socket|ServerSocket|DatagramSocket|HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|HttpHead")],
        FS: [_n("FileOutputStream|FileWriter|PrintWriter|PrintStream|RandomAccessFile"), _m("Files", "write|writeString|copy|move|createFile|createDirectory|createDirectories|newOutputStream|newBufferedWriter")], ENV: [],
    },
    "c#": {
        SHELL: [_m("Process", "Start"), _n("ProcessStartInfo|Process")], EVAL: [_m("Activator", "CreateInstance|CreateInstanceFrom"), _d("Invoke"), _m("CSharpScript", "EvaluateAsync|RunAsync|Create"), _m("Assembly", "Load|LoadFrom|LoadFile|UnsafeLoadFrom")],
        BASE64: [_m("Convert", "FromBase64String|FromBase64CharArray|FromHexString")],
        NET: [_d("GetAsync|PostAsync|PutAsync|DeleteAsync|PatchAsync|SendAsync|GetStringAsync|GetByteArrayAsync|GetStreamAsync"), _n("HttpClient|WebClient|HttpRequestMessage|HttpWebRequest|TcpClient|TcpListener|UdpClient|Socket"), _m("WebRequest|HttpWebRequest", "Create")],
        FS: [_m("File", "WriteAllText|WriteAllBytes|WriteAllLines|AppendAllText|AppendAllLines|Copy|Move|Replace|Create|CreateText|OpenWrite|AppendText"), _n("StreamWriter|BinaryWriter|FileStream"), _m("Directory", "CreateDirectory|Move|Delete")], ENV: [],
    },
    "bash": {
        SHELL: [r"(?m)(?:^|[;&|(]\s*)(?:sh|bash|zsh|dash|ash|ksh|exec|source)\s"], EVAL: [r"(?m)(?:^[ \t]*|[;&|(]\s*)eval\s"], BASE64: [r"(?m)(?:^[ \t]*|[;&|(]\s*)(?:base64|base32|xxd|uudecode)\b"],
        NET: [r"(?m)(?:^[ \t]*|[;&|(]\s*)(?:curl|wget|nc|ncat|netcat|telnet|scp|sftp|ftp|ssh)\s"], FS: [], ENV: [],
    },
    "c": _C, "cpp": _C,
    "elixir": {
        SHELL: [_m("System", "cmd|shell"), _m(":os|:erlang", "cmd|open_port")], EVAL: [_m("Code", "eval_string|eval_quoted|eval_file|compile_string|compile_quoted|require_file")], BASE64: [_m("Base", r"(?:url_|hex_)?decode(?:64|32|16)!?")],
        NET: [_m("HTTPoison|Req|Finch|Tesla|HTTPotion|Mint", "get!?|post!?|put!?|patch|delete|request|head"), _m(":httpc|:gen_tcp|:ssl|:inets", "request|connect|open")], FS: [_m("File", "write!?|open!?|cp!?|cp_r!?|rename!?|copy!?|touch!?|mkdir!?|mkdir_p!?|rm!?")], ENV: [],
    },
    "kotlin": {SHELL: [_d("exec"), _f("ProcessBuilder")], EVAL: [_d("eval")], BASE64: [_d("decode|decodeToString")], NET: [_d("openConnection|openStream|newCall")], FS: [_d("writeText|writeBytes|appendText|appendBytes|printWriter|bufferedWriter")], ENV: []},
    "swift": {SHELL: [_f("system|popen|execv|execvp|execl|posix_spawn|Process"), _d("launch|run")], BASE64: [r"\bData\s*\(\s*base64Encoded"], NET: [_d("dataTask|downloadTask|uploadTask")], FS: [_d("write|writeToFile|createFile")], EVAL: [], ENV: []},
    "lua": {
        SHELL: [_m("os", "execute"), _m("io", "popen"), _m(r"vim\.fn", "system|jobstart"), _m("vim", "system")], EVAL: [_f("loadstring|load|loadfile|dofile"), _m(r"vim\.api", "nvim_exec|nvim_exec2|nvim_exec_lua")],
        NET: [r"""require\s*\(?\s*['"](?:socket|http|ssl)""", _m(r"vim\.(?:loop|uv)", "new_tcp|new_udp")], ENV: [_m("os", "getenv"), _m(r"vim\.fn", "getenv"), r"\bvim\.env\b"], FS: [_m("io", "open"), _m(r"vim\.fn", "writefile")], HOOK: [_m("ffi", "load"), r"\bpackage\.(?:cpath|loadlib)\b"], BASE64: [],
    },
    "dart": {SHELL: [_m("Process", "run|start|runSync")], EVAL: [_m("Isolate", "spawnUri"), _m("Function", "apply")], BASE64: [r"\bbase64(?:Url)?\.decode\s*\(", _f("base64Decode")], NET: [_m("http", "get|post|put|delete|patch|head"), _f("HttpClient"), _m("Socket", "connect")], ENV: [r"\bPlatform\.environment\b"], FS: [_d("writeAsString|writeAsBytes|writeAsStringSync|writeAsBytesSync")]},
    "haskell": {SHELL: [r"\b(?:System\.Process|callCommand|callProcess|readProcess|createProcess|rawSystem)\b"], EVAL: [r"\b(?:Language\.Haskell\.Interpreter|unsafePerformIO|runInterpreter)\b"], BASE64: [r"\bData\.ByteString\.Base64\b"], NET: [r"\b(?:Network\.HTTP|Network\.Socket|Network\.Wreq|simpleHttp|httpLBS)\b"], ENV: [r"\b(?:getEnv|lookupEnv|getEnvironment)\b"], FS: [r"\b(?:writeFile|appendFile|copyFile|renameFile)\b"]},
    "gleam": {EVAL: [r"@external\b"], NET: [r"import\s+gleam(?:/http|/httpc|_http)", r"import\s+gleam_erlang/port"], ENV: [r"import\s+gleam_erlang/os"], FS: [r"import\s+(?:gleam_erlang/file|simplifile)"], SHELL: [r"import\s+gleam_erlang/atom"], BASE64: []},
}
IP = r"""['"`]https?://(?:[0-9]{1,3}\.){3}[0-9]{1,3}"""
# File extensions of the scanned languages.
SCANNED = {
    "js": "js mjs cjs jsx ts tsx cts mts", "py": "py pyw", "ruby": "rb gemspec", "cocoapods": "podspec", "go": "go", "php": "php", "rust": "rs", "java": "java", "c#": "cs", "bash": "sh bash", "c": "c h", "cpp": "cc cpp cxx hpp",
    "elixir": "ex exs", "kotlin": "kt kts", "swift": "swift", "lua": "lua", "dart": "dart", "haskell": "hs", "gleam": "gleam",
}


def scanned_language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    table = F.create_map(*[F.lit(x) for lang, exts in SCANNED.items() for e in exts.split() for x in (e, lang)])
    return F.try_element_at(table, ext)


def _found(patterns: list[str], code: Column, bare: Column) -> Column:
    """Whether one of the patterns occurs, each in the text that fits it."""
    quoted = [p for p in patterns if "'" in p or '"' in p]
    plain = [p for p in patterns if p not in quoted]
    hit = lambda text, ps: text.rlike("|".join(f"(?:{p})" for p in ps)) if ps else F.lit(False)
    return hit(code, quoted) | hit(bare, plain)


def capabilities(code: Column, bare: Column, language: Column) -> Column:
    """Capabilities of a masked source text, in the order of the capability table."""
    found = []
    for cap in (SHELL, EVAL, BASE64, NET, ENV, FS, HOOK):
        hit = F.lit(False)
        for lang, table in CAPABILITY_RULES.items():
            if table.get(cap):
                hit = F.when(language == lang, _found(table[cap], code, bare)).otherwise(hit)
        found.append(F.when(hit, cap))
    found.insert(6, F.when(language.isNotNull() & code.rlike(IP), RAW_IP))
    return F.array_compact(F.array(*found))


# How each language reads an environment variable by name.
_ENV_NAMES = {
    "js": r"""\bprocess\s*\.\s*env\s*\[\s*['"]([A-Za-z_][A-Za-z0-9_]*)""", "py": r"""\bos\s*\.\s*(?:environ\s*(?:\[|\.\s*get\s*\()|getenv\s*\()\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""", "ruby": r"""\bENV\s*(?:\[|\.fetch\s*\(?)\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
    "go": r'\bos\.(?:Getenv|LookupEnv)\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)"', "rust": r'\benv::(?:var|var_os)\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)"', "java": r'\bSystem\.getenv\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)"', "lua": r"""\bos\.getenv\s*\(\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
}


_ENV_MEMBER = r"\bprocess\s*\.\s*env\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)"


def env_reads(code: Column, bare: Column, language: Column) -> Column:
    """Names of environment variables that a masked source reads, sorted."""
    out = F.array().cast("array<string>")
    for lang, pattern in _ENV_NAMES.items():
        found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
        found = F.concat(found, F.regexp_extract_all(bare, F.lit(_ENV_MEMBER), F.lit(1))) if lang == "js" else found
        out = F.when(language == lang, found).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def build_scripts(code: Column, language: Column) -> Column:
    """Shell commands that a Lua plugin specification runs after installing (``build = "..."``)."""
    found = F.regexp_extract_all(code, F.lit(r"""[{,;]\s*build\s*=\s*(?:"([^"\n]*)"|'([^'\n]*)')"""), F.lit(0))
    scripts = F.transform(found, lambda x: F.regexp_replace(x, r"""(?s)\A[^"']*["'](.*)["']\z""", "$1"))
    return F.when(language == "lua", scripts).otherwise(F.array().cast("array<string>"))


_QUOTED = r"""['"]([^'"\n]*)['"]"""


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _import(module: Column, key: Column | None = None) -> Column:
    return F.struct(module.alias("module"), (module if key is None else key).alias("key"))


def _same(modules: Column) -> Column:
    return F.transform(modules, lambda m: _import(m))


def _php_uses(statement: Column) -> Column:
    """Names of one ``use`` statement, groups with their prefix."""
    bare = F.regexp_replace(statement, r"(?i)\A\s*(?:function|const)\s+", "")
    grouped = F.contains(bare, F.lit("{"))
    prefix = F.regexp_extract(bare, r"\A\s*([^{]*?)[\s\\\\]*\{", 1)
    items = F.split(F.when(grouped, F.regexp_extract(bare, r"\{([^}]*)", 1)).otherwise(bare), ",")
    names = F.transform(items, lambda x: F.regexp_extract(x, r"(?i)\A\s*(?:(?:function|const)\s+)?([^\s]+)", 1))
    return F.transform(F.filter(names, lambda x: x != ""), lambda x: F.when(grouped & (prefix != ""), F.concat(prefix, F.lit("\\"), x)).otherwise(x))


def _java(statement: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(statement, r"import\s+(?:static\s+)?([\w.$\s]+?)(?:\s*\.\s*\*)?\s*;", 1), r"\s+", "")
    wild, static = statement.rlike(r"\*\s*;"), statement.rlike(r"\Aimport\s+static\b")
    return _import(F.when(wild, F.concat(name, F.lit(".*"))).otherwise(name), F.when(static & ~wild, F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name))


def _csharp(statement: Column) -> Column:
    name = F.regexp_extract(statement, r"([\w.]+)\s*;", 1)
    return _import(name, F.when(statement.rlike(r"\busing\s+static\b"), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name))


def imports(code: Column, bare: Column, top: Column, language: Column) -> Column:
    """Imports of a masked source, distinct: array of (module as written, what its dependency key is taken from).

    ``top`` is ``bare`` without what stands in braces, for PHP, where ``use`` in a class takes in a trait.
    """
    js = F.concat(
        _all(code, r"""(?<![.\w$])(?:require|import)\s*\(\s*['"`]([^'"`\n]*)['"`]"""), _all(code, r"(?<![.\w$])import\s*[\w$*{},\s]*?\bfrom\s*" + _QUOTED),
        _all(code, r"(?<![.\w$])import\s*" + _QUOTED),
    )
    lists = F.flatten(F.transform(_all(bare, r"(?m)(?:^|[;:])[ \t]*import[ \t]+((?:[^\n;\\]|\\\n)+)"), lambda x: F.split(F.replace(x, F.lit("\\\n"), F.lit(" ")), ",")))
    py = F.concat(
        _all(bare, r"(?m)(?:^|[;:])[ \t]*from[ \t]+([^\s,;]+)[ \t]+import\b"), F.filter(F.transform(lists, lambda x: F.regexp_extract(x, r"\A\s*([^\s,]+)", 1)), lambda x: x != ""),
        _all(code, r"(?<![.\w])(?:__import__|importlib\s*\.\s*import_module)\s*\(\s*[rRuU]?" + _QUOTED),
    )
    go_path = r'["`]([^"`\n]*)["`]'
    go = F.concat(F.flatten(F.transform(_all(code, r"(?m)^[ \t]*import\s*\(([^)]*)\)"), lambda x: _all(x, go_path))), _all(code, r"(?m)^[ \t]*import\s+(?:[\w.]+\s+)?" + go_path))
    php = F.concat(
        _same(F.flatten(F.transform(_all(top, r"(?i)(?<![\w$\\>])use\s+([^;(){}]*(?:\{[^{};]*\})?[^;(){}]*);"), _php_uses))),
        F.transform(_all(code, r"""(?i)(?<![\w$>:])(?:include|require)(?:_once)?\s*(?:'([^'\n]*)'|"([^"\n$]*)")\s*(?=;|\?>|\)|,)""", 0), lambda x: _import(F.regexp_extract(x, _QUOTED, 1), F.lit(""))),
    )
    call = r"(?<![\w:@$])(?:%s)\s*\(?\s*" + _QUOTED
    ruby = F.concat(
        _same(F.filter(F.concat(_all(code, call % "require|load|gem"), _all(code, r"(?<![\w:@$])autoload\s*\(?\s*:\w+\s*,\s*" + _QUOTED)), lambda x: ~F.contains(x, F.lit("#{")))),
        F.transform(_all(code, call % "require_relative"), lambda x: _import(x, F.lit(""))),
    )
    rust = F.concat(_all(bare, r"(?<![\w$])use\s+([\w:{}*,#\s]+?)\s*;"), _all(bare, r"(?<![\w$])extern\s+crate\s+(\w+)"))
    java = F.transform(_all(bare, r"(?<![\w.$])import\s+(?:static\s+)?[\w.$\s]+?(?:\.\s*\*)?\s*;", 0), _java)
    csharp = F.transform(_all(bare, r"(?<![\w.])using\s+(?:static\s+)?(?:\w+\s*=\s*)?[\w.]+\s*;", 0), _csharp)
    out = F.array().cast("array<struct<module:string,key:string>>")
    for lang, found in {"js": _same(F.filter(js, lambda x: ~F.contains(x, F.lit("${")))), "py": _same(py), "go": _same(go), "php": php, "ruby": ruby, "cocoapods": ruby, "rust": _same(rust), "java": java, "c#": csharp}.items():
        out = F.when(language == lang, found).otherwise(out)
    return F.array_distinct(out)
