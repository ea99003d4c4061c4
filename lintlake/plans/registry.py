"""The registry of taint sources, sinks and sanitizers that lookups start from; callers may append rows of their own."""

from __future__ import annotations

# Fixed values: (kind, name, match, pattern, languages, level or category or what it sanitises, severity, cwe), in the order in which they are tried.
# match: sub is a substring, re a regular expression; both ignore case.
PATTERNS: list[tuple[str, str, str, str, str, str, str, str]] = [
    ('source', 'express_req_body', 'sub', 'req.body', 'javascript, typescript', 'CRITICAL', '', ''),
    ('source', 'express_req_query', 'sub', 'req.query', 'javascript, typescript', 'CRITICAL', '', ''),
    ('source', 'express_req_params', 'sub', 'req.params', 'javascript, typescript', 'CRITICAL', '', ''),
    ('source', 'express_req_cookies', 'sub', 'req.cookies', 'javascript, typescript', 'HIGH', '', ''),
    ('source', 'express_req_headers', 'sub', 'req.headers', 'javascript, typescript', 'HIGH', '', ''),
    ('source', 'koa_ctx_request_body', 'sub', 'ctx.request.body', 'javascript, typescript', 'CRITICAL', '', ''),
    ('source', 'koa_ctx_query', 'sub', 'ctx.query', 'javascript, typescript', 'CRITICAL', '', ''),
    ('source', 'location_search', 'sub', 'location.search', 'javascript, typescript', 'CRITICAL', '', ''),
    ('source', 'location_hash', 'sub', 'location.hash', 'javascript, typescript', 'HIGH', '', ''),
    ('source', 'document_cookie', 'sub', 'document.cookie', 'javascript, typescript', 'HIGH', '', ''),
    ('source', 'local_storage', 're', 'localStorage\\.(getItem|get)', 'javascript, typescript', 'MEDIUM', '', ''),
    ('source', 'process_argv', 'sub', 'process.argv', 'javascript, typescript', 'HIGH', '', ''),
    ('source', 'process_env', 'sub', 'process.env', 'javascript, typescript', 'MEDIUM', '', ''),
    ('source', 'flask_request_form', 'sub', 'request.form', 'python', 'CRITICAL', '', ''),
    ('source', 'flask_request_args', 'sub', 'request.args', 'python', 'CRITICAL', '', ''),
    ('source', 'flask_request_json', 'sub', 'request.json', 'python', 'CRITICAL', '', ''),
    ('source', 'flask_request_data', 'sub', 'request.data', 'python', 'CRITICAL', '', ''),
    ('source', 'flask_request_values', 'sub', 'request.values', 'python', 'CRITICAL', '', ''),
    ('source', 'flask_request_cookies', 'sub', 'request.cookies', 'python', 'HIGH', '', ''),
    ('source', 'django_request_get', 'sub', 'request.GET', 'python', 'CRITICAL', '', ''),
    ('source', 'django_request_post', 'sub', 'request.POST', 'python', 'CRITICAL', '', ''),
    ('source', 'django_request_files', 'sub', 'request.FILES', 'python', 'CRITICAL', '', ''),
    ('source', 'sys_argv', 'sub', 'sys.argv', 'python', 'HIGH', '', ''),
    ('source', 'os_environ', 'sub', 'os.environ', 'python', 'MEDIUM', '', ''),
    ('source', 'input_func', 're', '\\binput\\(', 'python', 'HIGH', '', ''),
    ('source', 'php_get', 're', '\\$_GET\\s*\\[', 'php', 'CRITICAL', '', ''),
    ('source', 'php_post', 're', '\\$_POST\\s*\\[', 'php', 'CRITICAL', '', ''),
    ('source', 'php_request', 're', '\\$_REQUEST\\s*\\[', 'php', 'CRITICAL', '', ''),
    ('source', 'php_cookie', 're', '\\$_COOKIE\\s*\\[', 'php', 'HIGH', '', ''),
    ('source', 'php_server', 're', '\\$_SERVER\\s*\\[', 'php', 'HIGH', '', ''),
    ('source', 'php_files', 're', '\\$_FILES\\s*\\[', 'php', 'CRITICAL', '', ''),
    ('source', 'php_session', 're', '\\$_SESSION\\s*\\[', 'php', 'HIGH', '', ''),
    ('source', 'php_input_stream', 're', 'file_get_contents\\s*\\(\\s*["\\\']php://input["\\\']', 'php', 'CRITICAL', '', ''),
    ('source', 'java_http_servlet_request_get_parameter', 're', '\\.getParameter\\s*\\(', 'java', 'CRITICAL', '', ''),
    ('source', 'java_http_servlet_request_get_header', 're', '\\.getHeader\\s*\\(', 'java', 'CRITICAL', '', ''),
    ('source', 'java_http_servlet_request_get_cookies', 're', '\\.getCookies\\s*\\(', 'java', 'HIGH', '', ''),
    ('source', 'java_spring_request_param', 'sub', '@RequestParam', 'java', 'CRITICAL', '', ''),
    ('source', 'java_spring_request_body', 'sub', '@RequestBody', 'java', 'CRITICAL', '', ''),
    ('source', 'java_scanner_stdin', 'sub', 'System.in', 'java', 'HIGH', '', ''),
    ('source', 'go_http_url_query', 're', '\\.URL\\.Query\\(', 'go', 'CRITICAL', '', ''),
    ('source', 'go_http_form_value', 're', '\\.FormValue\\s*\\(', 'go', 'CRITICAL', '', ''),
    ('source', 'go_web_query', 're', '\\.Query\\s*\\(', 'go', 'CRITICAL', '', ''),
    ('source', 'go_web_param', 're', '\\.Param\\s*\\(', 'go', 'CRITICAL', '', ''),
    ('source', 'go_web_post_form', 're', '\\.(PostForm|PostFormValue)\\s*\\(', 'go', 'CRITICAL', '', ''),
    ('source', 'go_web_default_query', 're', '\\.DefaultQuery\\s*\\(', 'go', 'CRITICAL', '', ''),
    ('source', 'go_http_header_get', 're', '\\.Header\\.Get\\s*\\(', 'go', 'HIGH', '', ''),
    ('source', 'go_http_body', 're', '\\.Body\\b', 'go', 'CRITICAL', '', ''),
    ('source', 'go_os_args', 'sub', 'os.Args', 'go', 'HIGH', '', ''),
    ('sink', 'eval', 'sub', 'eval(', 'javascript, typescript', 'RCE', 'Critical', 'CWE-94'),
    ('sink', 'function_constructor', 'sub', 'Function(', 'javascript, typescript', 'RCE', 'Critical', 'CWE-94'),
    ('sink', 'child_process_exec', 're', '(exec|execSync|spawn|spawnSync)\\(', 'javascript, typescript', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'vm_run', 're', 'vm\\.runIn(NewContext|Context|ThisContext)\\(', 'javascript, typescript', 'RCE', 'Critical', 'CWE-94'),
    ('sink', 'unserialize', 'sub', 'unserialize(', 'javascript, typescript', 'RCE', 'Critical', 'CWE-502'),
    ('sink', 'sql_query', 're', '\\b(?:connection|db|pool|client|cursor|sequelize|knex|pg|mysql|sqlite)\\b.*?\\.(query|execute|raw)\\(', 'javascript, typescript', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'mongo_find', 're', '\\.(find|findOne|findById|findOneAndUpdate|findOneAndDelete)\\(', 'javascript, typescript', 'NOSQL_INJECTION', 'High', 'CWE-943'),
    ('sink', 'mongo_update', 're', '\\.(update|updateOne|updateMany)\\(', 'javascript, typescript', 'NOSQL_INJECTION', 'High', 'CWE-943'),
    ('sink', 'mongo_delete', 're', '\\.(delete|deleteOne|deleteMany|remove)\\(', 'javascript, typescript', 'NOSQL_INJECTION', 'High', 'CWE-943'),
    ('sink', 'mongo_aggregate', 're', '\\.aggregate\\(', 'javascript, typescript', 'NOSQL_INJECTION', 'High', 'CWE-943'),
    ('sink', 'inner_html', 'sub', 'innerHTML', 'javascript, typescript', 'XSS', 'High', 'CWE-79'),
    ('sink', 'document_write', 'sub', 'document.write(', 'javascript, typescript', 'XSS', 'High', 'CWE-79'),
    ('sink', 'angular_bypass_security', 're', 'bypassSecurityTrust(Html|Script|Style|Url|ResourceUrl)\\(', 'javascript, typescript', 'XSS', 'High', 'CWE-79'),
    ('sink', 'fs_read', 're', '(readFile|readFileSync|createReadStream)\\(', 'javascript, typescript', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'fs_write', 're', '(writeFile|writeFileSync|createWriteStream)\\(', 'javascript, typescript', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'http_request', 're', '(?<![\\w$])(?:fetch|request|axios(?:\\.(?:request|get|post|put|delete|head|options|patch))?|https?\\.(?:get|request))\\s*\\(', 'javascript, typescript', 'SSRF', 'High', 'CWE-918'),
    ('sink', 'redirect', 're', '(redirect|location\\.href|location\\.assign)\\(', 'javascript, typescript', 'OPEN_REDIRECT', 'Medium', 'CWE-601'),
    ('sink', 'eval', 'sub', 'eval(', 'python', 'RCE', 'Critical', 'CWE-94'),
    ('sink', 'exec', 'sub', 'exec(', 'python', 'RCE', 'Critical', 'CWE-94'),
    ('sink', 'os_system', 'sub', 'os.system(', 'python', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'os_popen', 'sub', 'os.popen(', 'python', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'subprocess', 're', 'subprocess\\.(call|run|Popen|check_output)\\(', 'python', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'pickle_loads', 'sub', 'pickle.loads(', 'python', 'DESERIALIZATION', 'Critical', 'CWE-502'),
    ('sink', 'yaml_load', 'sub', 'yaml.load(', 'python', 'DESERIALIZATION', 'High', 'CWE-502'),
    ('sink', 'cursor_execute', 're', '\\w+\\.(execute|executemany)\\(', 'python', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'open_file', 'sub', 'open(', 'python', 'PATH_TRAVERSAL', 'Medium', 'CWE-22'),
    ('sink', 'os_path', 're', 'os\\.path\\.(join|abspath)\\(', 'python', 'PATH_TRAVERSAL', 'Medium', 'CWE-22'),
    ('sink', 'render_template_string', 'sub', 'render_template_string(', 'python', 'XSS', 'High', 'CWE-79'),
    ('sink', 'requests', 're', 'requests\\.(get|post|put|delete|head)\\(', 'python', 'SSRF', 'High', 'CWE-918'),
    ('sink', 'urllib', 're', 'urllib\\.(request\\.urlopen|urlopen)\\(', 'python', 'SSRF', 'High', 'CWE-918'),
    ('sink', 'redirect', 're', '\\bredirect\\s*\\(', 'python', 'OPEN_REDIRECT', 'Medium', 'CWE-601'),
    ('sink', 'http_response_redirect', 're', 'HttpResponseRedirect\\s*\\(', 'python', 'OPEN_REDIRECT', 'Medium', 'CWE-601'),
    ('sink', 'php_mysql_query', 're', '\\b(?:mysql_query|mysqli_query|pg_query)\\s*\\(', 'php', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'php_stmt_execute', 're', '\\$\\w+\\s*->\\s*(?:query|execute)\\s*\\(', 'php', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'php_system', 're', '\\bsystem\\s*\\(', 'php', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'php_exec', 're', '\\bexec\\s*\\(', 'php', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'php_shell_exec', 're', '\\bshell_exec\\s*\\(', 'php', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'php_passthru', 're', '\\bpassthru\\s*\\(', 'php', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'php_popen', 're', '\\bpopen\\s*\\(', 'php', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'php_eval', 're', '\\beval\\s*\\(', 'php', 'RCE', 'Critical', 'CWE-94'),
    ('sink', 'php_echo_print', 're', '\\b(?:echo|print|printf|fprintf)\\s+', 'php', 'XSS', 'High', 'CWE-79'),
    ('sink', 'php_header_location', 're', 'header\\s*\\(\\s*[\'\\"]location\\s*:', 'php', 'OPEN_REDIRECT', 'Medium', 'CWE-601'),
    ('sink', 'php_file_get_contents', 're', '\\bfile_get_contents\\s*\\(', 'php', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'php_include_require', 're', '\\b(?:include|require|include_once|require_once)\\s*\\(', 'php', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'php_fopen', 're', '\\bfopen\\s*\\(', 'php', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'php_readfile', 're', '\\breadfile\\s*\\(', 'php', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'php_unserialize', 're', '\\bunserialize\\s*\\(', 'php', 'DESERIALIZATION', 'High', 'CWE-502'),
    ('sink', 'java_statement_execute', 're', '\\bStatement\\b.*\\.execute(?:Query|Update)?\\s*\\(', 'java', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'java_connection_create_statement', 're', '\\bcreateStatement\\s*\\(', 'java', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'java_runtime_exec', 're', 'Runtime\\.getRuntime\\(\\)\\.exec\\s*\\(', 'java', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'java_process_builder_start', 're', 'ProcessBuilder\\s*\\(', 'java', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'java_response_writer_write', 're', '\\.getWriter\\(\\)\\.write\\s*\\(', 'java', 'XSS', 'High', 'CWE-79'),
    ('sink', 'java_response_send_redirect', 're', '\\.sendRedirect\\s*\\(', 'java', 'OPEN_REDIRECT', 'Medium', 'CWE-601'),
    ('sink', 'java_object_input_stream_read_object', 're', '\\.readObject\\s*\\(', 'java', 'DESERIALIZATION', 'High', 'CWE-502'),
    ('sink', 'java_file_new', 're', 'new\\s+File\\s*\\(', 'java', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'java_file_input_stream', 're', 'new\\s+FileInputStream\\s*\\(', 'java', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'go_db_query_exec', 're', '\\b(?:db|conn|connection|tx|stmt)\\.(Query|QueryContext|QueryRow|Exec|ExecContext)\\s*\\(', 'go', 'SQL_INJECTION', 'High', 'CWE-89'),
    ('sink', 'go_exec_command', 're', '\\bexec\\.Command\\s*\\(', 'go', 'RCE', 'Critical', 'CWE-78'),
    ('sink', 'go_fmt_fprintf', 're', '\\bfmt\\.Fprintf\\s*\\(', 'go', 'XSS', 'High', 'CWE-79'),
    ('sink', 'go_fiber_send_string', 're', '\\.SendString\\s*\\(', 'go', 'XSS', 'High', 'CWE-79'),
    ('sink', 'go_http_redirect', 're', '\\bhttp\\.Redirect\\s*\\(', 'go', 'OPEN_REDIRECT', 'Medium', 'CWE-601'),
    ('sink', 'go_os_open', 're', '\\bos\\.Open\\s*\\(', 'go', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'go_os_openfile', 're', '\\bos\\.OpenFile\\s*\\(', 'go', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'go_read_file', 're', '\\b(?:ioutil|os)\\.ReadFile\\s*\\(', 'go', 'PATH_TRAVERSAL', 'High', 'CWE-22'),
    ('sink', 'go_json_unmarshal', 're', '\\bjson\\.Unmarshal\\s*\\(', 'go', 'DESERIALIZATION', 'High', 'CWE-502'),
    ('sanitizer', 'escape_html_func', 're', '\\bescapeHtml\\s*\\(', 'javascript, typescript', 'XSS', '', ''),
    ('sanitizer', 'dompurify', 'sub', 'DOMPurify.sanitize(', 'javascript, typescript', 'XSS', '', ''),
    ('sanitizer', 'xss_filter', 're', '\\bxss\\s*\\(', 'javascript, typescript', 'XSS', '', ''),
    ('sanitizer', 'validator_escape', 'sub', 'validator.escape(', 'javascript, typescript', 'XSS', '', ''),
    ('sanitizer', 'parse_int', 'sub', 'parseInt(', 'javascript, typescript', 'SQL_INJECTION, NOSQL_INJECTION', '', ''),
    ('sanitizer', 'parse_float', 'sub', 'parseFloat(', 'javascript, typescript', 'SQL_INJECTION, NOSQL_INJECTION', '', ''),
    ('sanitizer', 'number_cast', 'sub', 'Number(', 'javascript, typescript', 'SQL_INJECTION, NOSQL_INJECTION', '', ''),
    ('sanitizer', 'mongo_sanitize', 'sub', 'mongoSanitize(', 'javascript, typescript', 'NOSQL_INJECTION', '', ''),
    ('sanitizer', 'path_basename', 're', 'path\\.basename\\(', 'javascript, typescript', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'path_normalize', 're', 'path\\.normalize\\(', 'javascript, typescript', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'path_resolve', 're', 'path\\.resolve\\(', 'javascript, typescript', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'html_escape_py', 're', 'html\\.escape\\(', 'python', 'XSS', '', ''),
    ('sanitizer', 'markupsafe_escape', 're', 'markupsafe\\.escape\\(', 'python', 'XSS', '', ''),
    ('sanitizer', 'bleach_clean', 'sub', 'bleach.clean(', 'python', 'XSS', '', ''),
    ('sanitizer', 'int_cast_py', 'sub', 'int(', 'python', 'SQL_INJECTION, NOSQL_INJECTION', '', ''),
    ('sanitizer', 'shlex_quote', 'sub', 'shlex.quote(', 'python', 'RCE', '', ''),
    ('sanitizer', 'os_path_basename_py', 'sub', 'os.path.basename(', 'python', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'os_path_normpath_py', 'sub', 'os.path.normpath(', 'python', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'php_htmlspecialchars', 're', '\\bhtmlspecialchars\\s*\\(', 'php', 'XSS', '', ''),
    ('sanitizer', 'php_htmlentities', 're', '\\bhtmlentities\\s*\\(', 'php', 'XSS', '', ''),
    ('sanitizer', 'php_intval', 're', '\\bintval\\s*\\(', 'php', 'SQL_INJECTION', '', ''),
    ('sanitizer', 'php_floatval', 're', '\\bfloatval\\s*\\(', 'php', 'SQL_INJECTION', '', ''),
    ('sanitizer', 'php_mysqli_real_escape_string', 're', '\\bmysqli_real_escape_string\\s*\\(', 'php', 'SQL_INJECTION', '', ''),
    ('sanitizer', 'php_addslashes', 're', '\\baddslashes\\s*\\(', 'php', 'SQL_INJECTION', '', ''),
    ('sanitizer', 'php_basename', 're', '\\bbasename\\s*\\(', 'php', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'php_realpath', 're', '\\brealpath\\s*\\(', 'php', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'php_escapeshellarg', 're', '\\bescapeshellarg\\s*\\(', 'php', 'RCE', '', ''),
    ('sanitizer', 'php_escapeshellcmd', 're', '\\bescapeshellcmd\\s*\\(', 'php', 'RCE', '', ''),
    ('sanitizer', 'java_prepared_statement', 're', '\\bprepareStatement\\s*\\(', 'java', 'SQL_INJECTION', '', ''),
    ('sanitizer', 'java_html_utils_html_escape', 're', 'HtmlUtils\\.htmlEscape\\s*\\(', 'java', 'XSS', '', ''),
    ('sanitizer', 'java_esapi_encoder', 're', 'ESAPI\\.encoder\\(\\)\\.encode', 'java', 'XSS', '', ''),
    ('sanitizer', 'java_integer_parse_int', 're', 'Integer\\.parseInt\\s*\\(', 'java', 'SQL_INJECTION', '', ''),
    ('sanitizer', 'java_paths_get_normalize', 're', 'Paths\\.get\\s*\\(', 'java', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'go_template_html_escape_string', 're', 'template\\.HTMLEscapeString\\s*\\(', 'go', 'XSS', '', ''),
    ('sanitizer', 'go_filepath_clean', 're', 'filepath\\.Clean\\s*\\(', 'go', 'PATH_TRAVERSAL', '', ''),
    ('sanitizer', 'go_strconv_atoi', 're', 'strconv\\.Atoi\\s*\\(', 'go', 'SQL_INJECTION, NOSQL_INJECTION', '', ''),
]
