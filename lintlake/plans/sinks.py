"""What the rules look for, by language: where input comes from, which calls are dangerous in which arguments, and what makes a value safe.

Fixed values, one table for all languages. A sink is (category, callee, arguments, how): arguments are positions, or None for all; how says when it counts:
taint - an argument carries input; dynamic - an argument isn't constant; build - a statement is put together from input or variables; always.
"""

from __future__ import annotations

TYPES = {"rce": "RCE_COMMAND_EXEC", "sql": "SQL_INJECTION", "nosql": "NOSQL_INJECTION", "xss": "XSS_RISK", "path": "PATH_TRAVERSAL", "ssrf": "SSRF", "redirect": "OPEN_REDIRECT", "deserialize": "DESERIALIZATION", "secret": "HARDCODED_CREDENTIALS"}
SEVERITY = {"rce": "Critical", "redirect": "Medium"}  # all others: High

SOURCES = {
    "python": r"\b(?:request|req)\.(?:form|args|json|data|values|cookies|headers|GET|POST|FILES|files|params|query_params|get_json|body|META|query_string)\b|\bsys\.argv\b|(?<![\w.])input\(|\bflask\.request\b",
    "javascript": r"\b(?:req|request)\.(?:body|query|params|cookies|headers|param|url|originalUrl|files?|session)\b|\bctx\.(?:request\.body|query|params|request\.query)\b|\blocation\.(?:search|hash|href)\b|\bdocument\.(?:cookie|URL|referrer|location)\b|\bwindow\.name\b|\bprocess\.argv\b|\blocalStorage\.get(?:Item)?\b|\bURLSearchParams\b",
    "php": r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER)\b|\$_FILES\b(?!\s*\[[^\]]*\]\s*\[\s*['\"]tmp_name)|php://input",
    "java": r"\b\w*(?:[rR]eq|exchange|ctx)\w*\s*\.\s*get(?:Parameter|ParameterValues|ParameterMap|Header|Headers|Cookies|QueryString|InputStream|Reader|PathInfo|RequestURI)\s*\(|\bSystem\.in\b|@(?:RequestParam|RequestBody|PathVariable|RequestHeader|CookieValue)\b",
    "go": r"\.URL\.(?:Query|Path|RawQuery)\b|\.(?:FormValue|PostFormValue|DefaultQuery|Query|QueryParam|Params?|PathValue|FormFile|Cookies?|BodyParser)\s*\(|\.(?:PostForm|Form)\b|\.Header\.Get\s*\(|\b(?:r|req|request)\.Body\b|\bmux\.Vars\b|\bos\.Args\b",
}
SINKS = {
    "python": [
        ("rce", r"(?<![\w.])(?:eval|exec|compile)", (0,), "code"),
        ("rce", r"\bos\.(?:system|popen|execv|execve|execvp|execvpe|spawn[lv]p?e?)", None, "dynamic"),
        ("rce", r"\bsubprocess\.(?:call|run|Popen|check_call|check_output|getoutput)", (0,), "command"),
        ("sql", r"\.(?:execute|executemany|executescript|raw)", (0,), "build"),
        ("nosql", r"\.(?:find|find_one|find_one_and_update|find_one_and_delete|find_one_and_replace|update|update_one|update_many|delete_one|delete_many|remove|aggregate|count_documents|replace_one)", (0,), "taint"),
        ("xss", r"\b(?:render_template_string|mark_safe|Markup|HttpResponse|make_response|Response)", (0,), "taint"),
        ("xss", r"\b(?:resp|response|res|self\.response)(?:\.out)?\.(?:write|send)", (0,), "taint"),
        ("path", r"(?<![\w.])(?:open|send_file|FileResponse|Path)", (0,), "taint"),
        ("path", r"\b(?:os\.(?:remove|unlink|rmdir|listdir|makedirs|mkdir|rename)|shutil\.(?:copy|copyfile|move|rmtree)|io\.open|send_from_directory)", None, "taint"),
        ("path", r"\bos\.path\.join", (-1,), "taint"),
        ("ssrf", r"\b(?:requests|httpx|session|client|http)\.(?:get|post|put|delete|head|patch|request|options)|\burllib\.(?:request\.)?(?:urlopen|urlretrieve|Request)|(?<![\w.])urlopen", None, "taint"),
        ("redirect", r"(?<![\w.])(?:redirect|HttpResponseRedirect|HttpResponsePermanentRedirect|RedirectResponse)|\bflask\.redirect", (0,), "taint"),
        ("deserialize", r"\b(?:pickle|cPickle|_pickle|dill|marshal|shelve|jsonpickle)\.(?:loads?|Unpickler|open|decode)", (0,), "dynamic"),
        ("deserialize", r"\byaml\.(?:load|load_all|unsafe_load|full_load)", (0,), "yaml"),
    ],
    "javascript": [
        ("rce", r"(?<![\w.$])(?:eval|Function)", None, "dynamic"),
        ("rce", r"(?<![\w$.])(?:child_process\.|cp\.|childProcess\.)?(?:exec|execSync|spawn|spawnSync|execFile|execFileSync)", (0,), "command"),
        ("rce", r"\bvm\.(?:runIn(?:New|This)?Context|Script|compileFunction)", (0,), "dynamic"),
        ("sql", r"\b(?:connection|conn|db|pool|client|cursor|sequelize|knex|pg|mysql|sqlite|database)\b[\w.$]*?\.(?:query|execute|raw|all|get|run)", (0,), "build"),
        ("nosql", r"\.(?:find|findOne|findOneAndUpdate|findOneAndDelete|findOneAndReplace|update|updateOne|updateMany|deleteOne|deleteMany|remove|aggregate|count|countDocuments|insert|insertOne|insertMany|findById|findByIdAndUpdate|findAndModify|replaceOne|save)", None, "query"),
        ("xss", r"\bdocument\.write(?:ln)?|\bbypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)|\.insertAdjacentHTML", None, "dynamic"),
        ("xss", r"\bres(?:ponse)?\.(?:send|write|end)", (0,), "taint"),
        ("path", r"\b(?:fs|fsp|fse|fs\.promises)\.(?:open|openSync|readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|readdir|readdirSync|stat|statSync|unlink|unlinkSync)|\bres\.(?:sendFile|download)", (0,), "taint"),
        ("ssrf", r"(?<![\w$.])(?:fetch|request|axios|got|needle)(?:\.(?:request|get|post|put|delete|head|options|patch))?|\bhttps?\.(?:get|request)", (0,), "taint"),
        ("redirect", r"\b(?:res|response|reply|ctx)\.redirect|\blocation\.(?:assign|replace)|(?<![\w.$])redirect", None, "taint"),
        ("deserialize", r"\b(?:serialize\.)?unserialize|\byaml\.(?:load|loadAll)|\bnodeSerialize\.unserialize|\bJSON\.parse", (0,), "taint"),
    ],
    "php": [
        ("rce", r"(?<![\w>$:])(?:system|exec|shell_exec|passthru|popen|proc_open|pcntl_exec|eval|assert|create_function)", None, "taint"),
        ("rce", r"(?<![\w>$:])(?:call_user_func|call_user_func_array)", None, "dispatch"),
        ("rce", r"(?<![\w>$:])preg_replace", None, "modifier"),
        ("sql", r"(?<![\w>$:])(?:mysql_query|mysqli_query|pg_query|sqlite_query|mysqli_multi_query)", None, "build"),
        ("sql", r"->\s*(?:query|exec|prepare|multi_query|raw|whereRaw|selectRaw)", (0,), "build"),
        ("nosql", r"->\s*(?:find|findOne|findAndModify|insert|insertOne|update|updateOne|updateMany|remove|deleteOne|deleteMany|aggregate|count|countDocuments|executeQuery)", None, "direct"),
        ("path", r"(?<![\w>$:])(?:file_get_contents|fopen|readfile|file|unlink|copy|rename|move_uploaded_file|file_put_contents|opendir|scandir|mkdir|rmdir)", None, "taint"),
        ("path", r"(?<![\w>$:])(?:include|include_once|require|require_once)", None, "taint"),
        ("ssrf", r"(?<![\w>$:])(?:file_get_contents|curl_init|fopen|get_headers|fsockopen|readfile)", (0,), "url"),
        ("ssrf", r"(?<![\w>$:])curl_setopt", (2,), "curl"),
        ("redirect", r"(?<![\w>$:])header", (0,), "location"),
        ("redirect", r"(?<![\w>$:])(?:wp_redirect|redirect)", (0,), "taint"),
        ("deserialize", r"(?<![\w>$:])unserialize", (0,), "unserialize"),
        ("xss", r"(?<![\w>$:])(?:print_r|printf|vprintf|exit|die|print|echo)", None, "taint"),
    ],
    "java": [
        ("rce", r"\b(?:getRuntime\s*\(\s*\)|runtime|rt)\s*\.\s*exec", (0,), "taint"),
        ("rce", r"\bnew\s+ProcessBuilder|\.command", None, "taint"),
        ("rce", r"\b\w*[eE]ngine\s*\.\s*eval|\bSystem\.(?:load|loadLibrary)|\bshell\s*\.\s*(?:evaluate|parse)", (0,), "taint"),
        ("sql", r"\.\s*(?:executeQuery|executeUpdate|execute|executeLargeUpdate|addBatch|prepareStatement|createQuery|createNativeQuery|queryForList|queryForObject|query|update)", (0,), "build"),
        ("nosql", r"\.\s*(?:find|findOne|findOneAndUpdate|findOneAndDelete|deleteOne|deleteMany|updateOne|updateMany|aggregate|countDocuments|replaceOne|insertOne)", None, "taint"),
        ("xss", r"\b(?:\w*[wW]riter\s*(?:\(\s*\))?|out|response\.\w+\(\)|pw)\s*\.\s*(?:write|print|println|append|format|printf)", None, "taint"),
        ("path", r"\bnew\s+(?:File|FileInputStream|FileOutputStream|FileReader|FileWriter|RandomAccessFile)|\bPaths\s*\.\s*get|\bPath\s*\.\s*of|\bFiles\s*\.\s*(?:read\w*|write\w*|new\w+|delete\w*|copy|move|lines|list)", None, "taint"),
        ("ssrf", r"\b\w*[rR]est[tT]emplate\s*(?:\(\s*\))?\s*\.\s*\w+|\b(?:webClient|client|httpClient)\b[\w.()\s]*?\.\s*(?:uri|send|execute|get|post)|\bnew\s+(?:URL|HttpGet|HttpPost)|\bURI\s*\.\s*create|\.openConnection|\.openStream", None, "taint"),
        ("redirect", r"\.\s*sendRedirect", (0,), "taint"),
        ("redirect", r"\.\s*(?:setHeader|addHeader)", (1,), "header"),
        ("deserialize", r"\.\s*(?:readObject|readUnshared)", None, "stream"),
        ("deserialize", r"\b\w*[yY]aml\w*\s*(?:\(\s*\))?\s*\.\s*load(?:All|As)?|\b\w*[xX][sS]tream\w*\s*\.\s*fromXML|\b\w*[mM]apper\w*\s*\.\s*readValue", (0,), "taint"),
    ],
    "go": [
        ("rce", r"\bexec\.Command(?:Context)?", None, "gocommand"),
        ("sql", r"\.(?:Query|QueryContext|QueryRow|QueryRowContext|Exec|ExecContext|Raw|Prepare)", None, "build"),
        ("nosql", r"\.(?:Find|FindOne|FindOneAndUpdate|FindOneAndDelete|UpdateOne|UpdateMany|DeleteOne|DeleteMany|Aggregate|CountDocuments|ReplaceOne)", None, "taint"),
        ("xss", r"\bfmt\.Fprint(?:f|ln)?|\b(?:w|rw|writer|c|ctx)\.(?:Write|WriteString|HTML|String)|\.SendString|\btemplate\.(?:HTML|JS|URL)|\bio\.WriteString", None, "taint"),
        ("path", r"\b(?:os\.(?:Open|OpenFile|ReadFile|WriteFile|Create|Remove|RemoveAll|Stat|Mkdir|MkdirAll)|ioutil\.(?:ReadFile|WriteFile|ReadDir)|http\.ServeFile|os\.Rename)|\bc\.(?:File|SendFile)", None, "taint"),
        ("ssrf", r"\bhttp\.(?:Get|Post|Head|PostForm|NewRequest|NewRequestWithContext)|\b\w*[cC]lient\.(?:Get|Post|Head|PostForm)", None, "taint"),
        ("redirect", r"\bhttp\.Redirect|\b(?:c|ctx|context)\.Redirect", None, "taint"),
        ("deserialize", r"\b(?:json|yaml|xml|gob)\.(?:Unmarshal|NewDecoder|UnmarshalStrict)", (0,), "taint"),
    ],
}
#: Assignments that are sinks: (category, left side, how)
ASSIGNED = {
    "javascript": [("xss", r"\.(?:innerHTML|outerHTML)\Z", "dynamic"), ("redirect", r"(?:\blocation|\blocation\.href)\Z", "taint")],
}
#: Calls that make a value safe, by category; "*" for all.
SAFE = {
    "python": {"xss": r"(?:html\.escape|markupsafe\.escape|(?<![\w.])escape|bleach\.clean|conditional_escape|jsonify|json\.dumps|render_template)", "path": r"(?:os\.path\.basename|secure_filename|os\.path\.normpath|safe_join|\.name\b|\.stem\b)", "rce": r"(?:shlex\.quote|pipes\.quote|ast\.literal_eval)", "*": r"(?<![\w.])(?:int|float|bool|len|UUID|uuid\.UUID|ObjectId)", "redirect": r"(?:url_for|reverse)", "ssrf": r"(?:validate_url|is_safe_url|url_for)"},
    "javascript": {"xss": r"(?:escapeHtml|DOMPurify\.sanitize|\bxss|validator\.escape|encodeURIComponent|sanitize\w*|escape|JSON\.stringify|he\.encode)", "path": r"(?:path\.basename|path\.normalize|sanitizeFilename)", "nosql": r"(?:mongoSanitize|sanitize|String|ObjectId|toString)", "*": r"(?<![\w.$])(?:parseInt|parseFloat|Number|Boolean)", "rce": r"(?:shellescape|quote)", "redirect": r"(?:encodeURIComponent)", "ssrf": r"(?:encodeURIComponent)", "sql": r"(?:\w+\.escape(?:Id)?|\bescape)"},
    "php": {"xss": r"(?:htmlspecialchars|htmlentities|json_encode|urlencode|rawurlencode|esc_html|e)", "path": r"(?:basename|realpath|pathinfo|md5|uniqid|sha1)", "rce": r"(?:escapeshellarg|escapeshellcmd)", "sql": r"(?:mysqli_real_escape_string|mysql_real_escape_string|->\s*real_escape_string|->\s*quote|addslashes|pg_escape_string)", "*": r"(?<![\w>$])(?:intval|floatval|\(\s*(?:int|float|bool|integer)\s*\)|count|strlen|md5|sha1|in_array|is_numeric|ctype_digit|filter_var|preg_match|isset|empty)", "redirect": r"(?:urlencode|rawurlencode)"},
    "java": {"xss": r"(?:HtmlUtils\.htmlEscape|ESAPI\.encoder\(\)\.encode\w*|escapeHtml\d?|Encode\.forHtml\w*|StringEscapeUtils\.\w+|HtmlEscapers\.\w+)", "path": r"(?:normalize|getFileName|FilenameUtils\.getName|getName)", "*": r"\b(?:Integer\.parseInt|Integer\.valueOf|Long\.parseLong|Long\.valueOf|UUID\.fromString|Boolean\.parseBoolean|Double\.parseDouble|new\s+ObjectId)"},
    "go": {"xss": r"(?:template\.HTMLEscapeString|html\.EscapeString|template\.HTMLEscaper|url\.QueryEscape|strconv\.Quote)", "path": r"(?:filepath\.Base|path\.Base|securejoin\.SecureJoin)", "*": r"\b(?:strconv\.(?:Atoi|ParseInt|ParseFloat|ParseBool|ParseUint)|uuid\.Parse|primitive\.ObjectIDFromHex|len)", "redirect": r"(?:url\.QueryEscape)", "ssrf": r"(?:url\.QueryEscape)"},
}
CREDENTIAL_NAMES = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api_?key|apikey|access_?key|private_?key|auth_?key|credential|client_?secret)"
CREDENTIAL_SAFE = r"(?i)^(?:$|change_?me.*|your[-_ ].*|.*(?:example|placeholder|dummy|sample|xxxx|todo|replace|insert).*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\*+|null|none|undefined|true|false|test(?:ing)?\d*|password|passwd|secret|token|string|admin|key|default|n/?a|env|.*process\.env.*|.*os\.environ.*|.*\s.*)$"
