"""Grammars of statements for the chart parser, one for each language with brackets, and the lexical rules."""

from __future__ import annotations

_JS_EXPR = """
expr = assign (',' assign)*
assign = 'async'? (I | '(p') (':' type)? '=>' body | 'yield' '*'? assign? | unary (bin unary)* ('?' assign ':' assign)?
body = '{b' | assign
bin = BIN | BINUN | '=' | '>' | '>' '>' | '>' '>' '>' | '<' | 'in' | 'instanceof' | '*' | '|' | BITAND
unary = (un | BINUN | INC | 'typeof' | 'void' | 'delete' | 'await' | 'new')* post
post = prim tail*
prim = I | ki | LIT | TPL | '(a' | '[a' | '{o' | 'this' | 'super' | 'null' | 'function' '*'? name? '(p' '{b' | 'async' 'function' '*'? name? '(p' '{b' | 'class' name? ('extends' post)? '{c' | 'import' '(a' | 'import' '.' I | 'new' '.' I
un = '!' | '~'
ki = 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'let' | 'static' | 'type' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'keyof' | 'unique' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'global' | 'override' | 'accessor' | 'out' | 'public' | 'private' | 'protected' | 'implements' | 'interface' | 'yield' | 'await' | 'target' | 'meta'
tail = '.' member | QDOT (member | '(a' | '[a') | '(a' | '[a' | TPL | INC
member = I | ki | PRIV | 'this' | 'null' | 'in' | 'new' | 'typeof' | 'void' | 'delete' | 'await' | 'function' | 'class' | 'import' | 'super' | 'instanceof' | 'async' | 'yield' | 'if' | 'else' | 'for' | 'while' | 'do' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'return' | 'throw' | 'break' | 'continue' | 'const' | 'var' | 'let' | 'export' | 'extends' | 'static' | 'get' | 'set' | 'of' | 'from' | 'as'
name = I | ki
args = arg? (',' arg)* ','?
arg = '...'? assign
array = (',' | '...'? assign)*
object = prop? (',' prop)* ','?
prop = '...' assign | key ':' assign | name ('=' assign)? | 'async'? '*'? key '(p' '{b' | ('get' | 'set') key '(p' '{b'
key = member | LIT | '[a'
target = name | '[a' | '{o'
"""
_JS_STMT = """
line = bstmt* stmt?
stmt = bstmt | simple | head (stmt ('else' stmt?)?)? | name ':' stmt | 'else' stmt? | 'do' stmt | 'while' '(a'
head = 'if' '(a' | 'for' 'await'? '(f' | 'while' '(a' | 'else'
bstmt = '{b' | head* '{b' | 'do' '{b' ('while' '(a')? | 'try' '{b' ('catch' '(p'? '{b')? ('finally' '{b')? | 'catch' '(p'? '{b' | 'finally' '{b' | 'switch' '(a' '{s' | ('export' 'default'?)? fn | ('export' 'default'?)? klass | head fn | head 'switch' '(a' '{s' | name ':' bstmt
fn = 'async'? 'function' '*'? name? '(p' '{b'
klass = 'class' name? ('extends' post)? '{c'
simple = expr | 'return' expr? | 'throw' expr | 'break' name? | 'continue' name? | 'debugger' | 'export'? decl | imp | exp
decl = ('var' | 'let' | 'const') bind (',' bind)*
bind = target ('=' assign)?
imp = 'import' LIT withs? | 'import' impwhat 'from' LIT withs?
impwhat = name | name ',' '{i' | '{i' | '*' 'as' name | name ',' '*' 'as' name
withs = 'with' '{o'
exp = 'export' '{i' ('from' LIT withs?)? | 'export' '*' ('as' member)? 'from' LIT | 'export' 'default' assign
specs = spec? (',' spec)* ','?
spec = (member | LIT) ('as' (member | LIT))?
params = param? (',' param)* ','?
param = '...'? target ('=' assign)?
forhead = (('var' | 'let' | 'const') target | target | post) ('of' assign | 'in' expr) | fordecl? ';' expr? ';' expr?
fordecl = ('var' | 'let' | 'const') bind (',' bind)* | expr
caseline = case* line
case = 'case' expr ':' | 'default' ':'
member_line = (method | field)* | fieldlast
method = ';' | mods 'async'? '*'? (key | PRIV) '(p' '{b' | mods ('get' | 'set') (key | PRIV) '(p' '{b' | 'static' '{b'
mods = 'static'?
field = mods (key | PRIV) ('=' assign)? ';'
fieldlast = (method | field)* mods (key | PRIV) ('=' assign)?
"""
_TYPE = """
type = tparams? '(p' '=>' type | 'abstract'? 'new' tparams? '(p' '=>' type | untype ('extends' type '?' type ':' type)? | ('asserts')? (I | 'this') 'is' type
untype = ('|' | BITAND)? ptype (('|' | BITAND) ptype)*
ptype = ('keyof' | 'readonly' | 'unique' | 'infer' | 'typeof')* tprim ('[a' | '[e')*
tprim = tname targs? | LIT | TPL | BINUN LIT | '(t' | '(y' | '[t' | '{t' | 'null' | 'void' | 'this' | 'import' '(a' ('.' I)* targs?
tname = (I | ki) ('.' (I | ki))*
targs = '<' type (',' type)* ','? '>'
tparams = '<' tparam (',' tparam)* ','? '>'
tparam = ('const' | 'in' | 'out')* (I | ki) ('extends' type)? ('=' type)?
types = ttype? (',' ttype)* ','?
ttype = '...'? ((I | ki) '?'? ':')? type '?'?
onetype = type
"""
JS = _JS_EXPR + _JS_STMT + "type = I\n"
_TS_EXPR = (
    _JS_EXPR.replace("assign = 'async'? (I | '(p') (':' type)? '=>' body", "assign = 'async'? (I | tparams? '(p' (':' type)?) '=>' body")
    .replace("tail = ", "tail = ('as' | 'satisfies') ('const' | type) | '!' | targs '(a' | ")
    .replace("unary = (un |", "unary = ('<' type '>' | un |")
    .replace("'function' '*'? name? '(p' '{b'", "'function' '*'? name? tparams? '(p' (':' type)? '{b'")
    .replace("'class' name? ('extends' post)? '{c'", "'class' name? tparams? ('extends' post targs?)? ('implements' type (',' type)*)? '{c'")
    .replace("key '(p' '{b'", "key tparams? '(p' (':' type)? '{b'")
)
_TS_STMT = (
    _JS_STMT.replace("fn = 'async'? 'function' '*'? name? '(p' '{b'", "fn = 'declare'? 'async'? 'function' '*'? name? tparams? '(p' (':' type)? '{b'")
    .replace("klass = 'class' name? ('extends' post)? '{c'", "klass = deco* ('declare' | 'abstract')* 'class' name? tparams? ('extends' post targs?)? ('implements' type (',' type)*)? '{c' | ('declare' | 'const')* 'enum' name '{e' | 'declare'? 'interface' name tparams? ('extends' type (',' type)*)? '{t' | 'declare'? ('namespace' | 'module') (name ('.' name)* | LIT) '{b' | 'declare' 'global' '{b'\ndeco = '@' post")
    .replace("bind = target ('=' assign)?", "bind = target '!'? (':' type)? ('=' assign)?")
    .replace("param = '...'? target ('=' assign)?", "param = deco* ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? (target | 'this') '?'? (':' type)? ('=' assign)?")
    .replace("'export'? decl |", "'export'? 'declare'? decl | 'export'? 'declare'? 'type' name tparams? '=' type | 'export'? 'declare'? 'async'? 'function' '*'? name tparams? '(p' (':' type)? | 'export' '=' assign | 'import' name '=' expr | 'export' 'as' 'namespace' name |")
    .replace("imp = 'import' LIT withs? | 'import' impwhat", "imp = 'import' LIT withs? | 'import' 'type'? impwhat")
    .replace("exp = 'export' '{i'", "exp = 'export' 'type'? '{i'")
    .replace("spec = (member", "spec = 'type'? (member")
    .replace("mods = 'static'?", "mods = deco* ('static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor')*")
    .replace("(key | PRIV) '(p' '{b'", "(key | PRIV) '?'? tparams? '(p' (':' type)? '{b'")
    .replace("field = mods (key | PRIV) ('=' assign)? ';'", "field = mods (key | PRIV) ('?' | '!')? (':' type)? ('=' assign)? ';' | mods 'async'? (key | PRIV) '?'? tparams? '(p' (':' type)? ';' | mods '[a' ':' type ';' | mods '[x' ':' type ';'")
    .replace("fieldlast = (method | field)* mods (key | PRIV) ('=' assign)?", "fieldlast = (method | field)* (mods (key | PRIV) ('?' | '!')? (':' type)? ('=' assign)? | mods (key | PRIV) '?'? tparams? '(p' (':' type)? | mods '[x' ':' type)")
)
TS = (
    _TS_EXPR
    + _TS_STMT
    + _TYPE
    + """
tmembers = tmember? (sep+ tmember)* sep*
sep = ';' | ',' | NL
tmember = ('readonly' | BINUN 'readonly')? (key | '[x') ('?' | BINUN '?')? (':' type)? | ('get' | 'set')? key '?'? tparams? '(p' (':' type)? | tparams? '(p' (':' type)? | 'new' tparams? '(p' (':' type)?
index = (I | ki) (':' | 'in') type ('as' type)?
enums = enum? (',' enum)* ','?
enum = (member | LIT) ('=' assign)?
"""
)
JAVA = """
un = '!' | '~'
line = bstmt* stmt?
stmt = bstmt | simple | head (stmt ('else' stmt?)?)? | I ':' stmt | 'else' stmt? | 'do' stmt
head = 'if' '(a' | 'for' '(f' | 'while' '(a' | 'else'
bstmt = '{b' | head* '{b' | 'do' '{b' | 'try' '(r'? '{b' catch* ('finally' '{b')? | catch | 'finally' '{b' | 'switch' '(a' '{s' | 'synchronized' '(a' '{b' | type_decl | head 'switch' '(a' '{s' | I ':' bstmt
catch = 'catch' '(k' '{b'
simple = expr | 'return' expr? | 'throw' expr | 'break' I? | 'continue' I? | 'yield' expr | 'assert' expr (':' expr)? | local | 'while' '(a'
local = (ann | 'final')* type declr (',' declr)*
declr = I '[e'* ('=' (expr | '{n'))?
expr = asg
asg = (I | '(p') ARROW ('{b' | asg) | unary (bin unary | 'instanceof' ('final')? (type I? | type '(k'))* ('?' asg ':' asg)?
bin = BIN | BINUN | '=' | '>' | '>' '>' | '>' '>' '>' | '<' | '*' | BITAND | '|'
unary = (un | BINUN | INC)* cast
cast = '(y' cast | post
post = prim tail*
prim = I | LIT | 'null' | '(a' | 'this' | 'super' | 'new' ann* tname targs? '(a' '{c'? | 'new' ann* (tname targs? | PT) ('[a' | '[e')+ '{n'? | 'switch' '(a' '{s' | type '.' 'class' | PT ('[e')* '.' 'class' | type DCOLON (I | 'new') | PT '[e'+ DCOLON 'new'
tail = '.' (I | 'this' | 'class' | 'super' | 'new' post) | '.' targs I | '(a' | '[a' | INC | DCOLON (I | 'new')
args = asg? (',' asg)*
type = ann* (PT | tname targs? ('.' I targs?)*) (ann* '[e')*
tname = I ('.' I)*
targs = '<' (targ (',' targ)*)? '>'
targ = type | ann* '?' (('extends' | 'super') type)?
tparams = '<' tparam (',' tparam)* '>'
tparam = ann* I ('extends' type (BITAND type)*)?
onetype = type (BITAND type)*
ann = '@' I ('.' I)* '(v'?
annargs = (annarg (',' annarg)*)?
annarg = (I '=')? (asg | '{n' | ann)
params = param? (',' param)* | I (',' I)*
param = (ann | 'final')* type '...'? (I '[e'* | 'this')
init = initv? (',' initv)* ','?
initv = asg | '{n'
catchp = ('final' | ann)* type ('|' type)* I | ((ann | 'final')* (type I | type '(k') (',' (type I | type '(k'))*)?
forhead = ('final' | ann)* type I ':' expr | (local | asg (',' asg)*)? ';' expr? ';' (asg (',' asg)*)?
resources = res? (';' res)* ';'?
res = ('final')? type I '=' expr | post
cases = label*
label = case ':' | case ARROW (bstmt | simple ';' | '{b' | 'throw' expr ';') | bstmt | stmt ';' | ';'
case = 'case' pat (',' pat)* ('when' expr)? | 'default'
pat = asg | 'null' | 'default' | type I | type '(k'
mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' | ann
type_decl = mod* ('class' I tparams? ('extends' type)? ('implements' type (',' type)*)? ('permits' type (',' type)*)? '{c' | 'interface' I tparams? ('extends' type (',' type)*)? ('permits' type (',' type)*)? '{c' | 'enum' I ('implements' type (',' type)*)? '{u' | 'record' I tparams? '(p' ('implements' type (',' type)*)? '{c' | '@' 'interface' I '{c')
top = (type_decl | ';' | pkg ';' | imp ';')* (pkg | imp)?
pkg = ann* 'package' tname
imp = 'import' ('static' | 'module')? tname ('.' '*')?
members = (memberd | ';')*
memberd = type_decl | 'static'? '{b' | mod* tparams? (type | 'void') I '(p' '[e'* throws? ('{b' | ('default' (asg | '{n'))? ';') | mod* tparams? I '(p' throws? '{b' | mod* I '{b' | mod* type declr (',' declr)* ';'
throws = 'throws' type (',' type)*
enums = (ann* I '(a'? '{c'? (',' ann* I '(a'? '{c'?)*)? ','? (';' members)?
"""
GO = """
un = '!'
line = stmt? (';' stmt?)*
stmt = simple | 'var' vspec | 'var' '(v' | 'const' vspec | 'const' '(v' | 'const' I | 'type' tspec | 'type' '(w' | 'return' exprs? | 'if' ifhead '{b' ('else' 'if' ifhead '{b')* ('else' '{b')? | 'for' forhead? '{b' | 'switch' swhead? '{s' | 'select' '{s' | 'go' expr | 'defer' expr | 'break' I? | 'continue' I? | 'goto' I | 'fallthrough' | I ':' stmt? | '{b'
simple = exprs | exprs ('=' | ':=' | OPEQ) exprs | expr INC | expr '<-' expr
ifhead = (simple ';')? xexpr
xsimple = xexpr | exprs ('=' | ':=' | OPEQ) xexprs | expr INC
forhead = xexpr | simple? ';' expr? ';' xsimple? | (exprs ('=' | ':='))? 'range' xexpr
swhead = (simple? ';')? ((I ':=')? xexpr)? | simple ';'
xexprs = xexpr (',' xexpr)*
xexpr = xunary (bin xunary)*
xunary = (un | BINUN | '*' | '<-' | BITAND)* xpost
xpost = xprim tail*
xprim = I | LIT | '(a' | 'func' sig '{b' | '[' | arr '{n'? | 'map' '[t' type '{n'?
exprs = expr (',' expr)*
expr = unary (bin unary)*
bin = BIN | BINUN | '*' | '<-' | BITAND | '|' | '<' | '>'
unary = (un | BINUN | '*' | '<-' | BITAND)* post
post = prim tail*
prim = I | LIT | '(a' | 'func' sig '{b' | tname '[t'? '{n' | arr '{n'? | 'map' '[t' type '{n'? | 'struct' '{f' '{n'? | 'chan' type | 'interface' '{j' | '{n'
tail = '.' (I | '(a' | '(z') | '(a' | '[a' | '[l' | '[t'
arr = ('[e' | '[a') type
args = (garg (',' garg)* '...'? ','?)?
garg = expr | type
index = expr (',' expr)* ','? | type (',' type)* ','?
slice = expr? ':' expr? (':' expr?)?
type = tname '[t'? | '*' type | ('[e' | '[a' | '[d') type | 'map' '[t' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' '{f' | 'interface' '{j' | '(y'
onetype = type
tname = I ('.' I)?
sig = '(p' (type | '(p')?
params = (param (',' param)* ','?)?
param = I? '...'? type | I
vspec = I (',' I)* type? ('=' exprs)?
tspec = I ('[q')? '='? type
tparams = I (',' I)* constraint (',' I (',' I)* constraint)* ','?
constraint = cterm ('|' cterm)*
cterm = '~'? type
elements = (elem (',' elem)* ','?)?
elem = (expr | '{n') (':' (expr | '{n'))?
fieldl = (I (',' I)* type | '*'? tname '[t'?) LIT?
ifacel = I sig | constraint
case = 'case' exprs ':' | 'default' ':' | 'case' (exprs ('=' | ':='))? expr ':' | 'case' type (',' type)* ':' | 'case' expr '<-' expr ':'
caseline = case* line
zkind = 'type'
top = 'package' I | 'import' ('.' | I)? LIT | 'import' '(m' | 'func' ('(p')? I ('[q')? sig '{b'? | 'var' vspec | 'var' '(v' | 'const' vspec | 'const' '(v' | 'type' tspec | 'type' '(w'
impl = ('.' | I)? LIT
vspecl = vspec | I (',' I)*
"""

RUBY = """
stmt = ('alias' (I | CONST | LIT) (I | CONST | LIT) | expr) (('if' | 'unless' | 'while' | 'until' | 'rescue') expr)*
expr = notx (('and' | 'or') notx)*
notx = ('not' | '!')* (jump | asg)
jump = ('return' | 'break' | 'next' | 'redo' | 'retry') list?
asg = lhs (ASG lhs)* (ASG (cmd | list | jump))? | cmd
lhs = lhsv (',' lhsv)* ','?
lhsv = '*'? arg | '*' | '**' arg
list = item (',' item)*
item = '*' arg | BITAND arg? | '**' arg | LABEL (arg | cmd)? | arg ('=>' arg)?
cmd = post list DO?
arg = un (bin un)* ('?' arg (':' | LABELEND) arg)? ('..' un?)?
bin = BIN | BINUN | '*' | '**' | '<' | '>' | BITAND | '|' | '..' | '=~' | ASG | '<<'
un = ('!' | BINUN | '~' | 'defined?' | '..' | BITAND | '::')* post
post = prim tail*
prim = I | CONST | LIT+ | '(a' | '[a' | '{h' | GRP | 'self' | 'nil' | 'yield' | 'super' | '->' ('(p' | I (',' I)*)? ('{k' | DO) | '__method__' | 'then'
tail = ('.' | '&.') (I | CONST | '(a') '!'? | '(a' | '[a' | '{k' | DO | '::' (I | CONST)
args = (item (',' item)* ','?)? | cmd | DO
array = (item (',' item)* ','?)?
hash = (pair (',' pair)* ','?)?
pair = LABEL (arg | cmd)? | '**' arg | arg '=>' (arg | cmd)
params = (param (',' param)* ','?)?
param = I (ASG arg)? | LABEL arg? | '*' I? | '**' (I | 'nil')? | BITAND I? | '(p' | '...'
blockp = '|' params (';' I (',' I)*)? '|'
def_head = ((I | CONST | 'self') '.')? name ('(p' | params) | ((I | CONST | 'self') '.')? name '(p'? ASG (cmd | stmt)
name = (I | CONST) ASG? | BIN | BINUN | '*' | '<' | '>' | '<<' | '[a' ASG? | '=~' | '!' | BITAND | '|' | '**' | 'self' | 'nil' | LIT | '~'
class_head = CONST ('::' CONST)* ('<' expr)? | '<<' expr
module_head = CONST ('::' CONST)*
cond_head = stmt ('then' stmt?)?
loop_head = stmt ('do' stmt?)?
case_head = stmt?
for_head = lhs 'in' expr 'do'?
begin_head = stmt?
do_head = blockp? stmt?
part = 'else' stmt? | 'elsif' stmt ('then' stmt?)? | 'when' list ('then' stmt?)? | 'in' list (('if' | 'unless') expr)? ('then' stmt?)? | 'rescue' list? ('=>' arg)? ('then' stmt?)? | 'ensure' stmt?
"""

PYTHON = """
line = simple (';' simple)* ';'?
simple = 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') I (',' I)* | 'del' stars | 'assert' test (',' test)? | imp | I I '[a'? '=' test | assigned
imp = 'import' dotted ('as' I)? (',' dotted ('as' I)?)* | 'from' from 'import' ('*' | '(a' | I ('as' I)? (',' I ('as' I)?)*)
from = ('.' | '...')+ dotted? | dotted
dotted = I ('.' I)*
assigned = rhs (':' test ('=' rhs)? | AUG rhs | ('=' rhs)*)
rhs = yield | stars
yield = 'yield' ('from' test | stars)?
stars = star (',' star)* ','?
star = '*' ors | named
named = I ':=' test | test
test = 'lambda' lparams? ':' test | ors ('if' ors 'else' test)?
ors = unary (bin unary)*
bin = BIN | BINUN | '*' | '**' | '/' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'?
unary = ('not' | BINUN | '~' | 'await')* post
post = prim ('.' I | '(a' | '[a')*
prim = I | LIT | STR+ | '(a' | '[a' | '{a' | '...' | 'None' | 'True' | 'False'
comp = ('async'? 'for' targets 'in' ors ('if' test)*)+
targets = target (',' target)* ','?
target = '*'? post
parens = yield | (item (',' item)* ','?)?
item = ('*' | '**') test | I '=' test | named (comp | 'as' post)?
index = (slice (',' slice)* ','?)?
slice = test? ':' test? (':' test?)? | I (':' test)? '=' test | '**' I ('=' test)? | '*' test ('=' test)? | item
braces = (pair (',' pair)* ','?)?
pair = test ':' test (comp | 'as' I)? | '**' ors | item
params = (param (',' param)* ','?)?
param = '*' (I (':' star)?)? | '**' I (':' test)? | '/' | I (':' test)? ('=' test)?
lparams = lparam (',' lparam)* ','?
lparam = '*' I? | '**' I | '/' | I ('=' test)?
head = ('if' | 'elif' | 'while') named ':' | ('else' | 'try' | 'finally') ':' | 'except' '*'? (test (',' test)* ','? ('as' I)?)? ':' | 'async'? 'for' targets 'in' stars ':' | 'async'? 'with' with (',' with)* ':' | 'async'? 'def' I '[a'? '(p' ('->' stars)? ':' | 'class' I '[a'? '(a'? ':'
with = test ('as' target)?
match = I stars ':'
case = I pattern (',' pattern)* ','? ('if' named)? ':'
pattern = '*' I | ors ('as' I)?
headline = head line
matchline = match line
caseline = case line
deco = '@' named
block = (SIMPLE | IF ELIF* ELSE? | (FOR | WHILE) ELSE? | TRY (EXCEPT+ ELSE? FINALLY? | FINALLY) | WITH | DECO* (DEF | CLASS) | MATCH)*
cases = CASE+
"""
