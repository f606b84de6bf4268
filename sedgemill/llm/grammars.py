"""Grammars of nine languages in the notation of ``peg``. They say what a program is, not what it means: operators have no
precedence here, and what only a type checker can tell apart is one form."""

TYPESCRIPT = r"""
start: item* EOF
item: import_decl / export_decl / stmt
import_decl: 'import' !'(' !'.' ("type" !"from" &(ID / '{' / '*'))? (STR / import_clause "from" STR) import_with? EOS / 'import' "type"? ID '=' e EOS
import_with: ('with' / "assert") object
import_clause: ID (',' (star_as / named))? / star_as / named
star_as: '*' "as" ID
named: '{' (spec (',' spec)* ','?)? '}'
spec: ("type" !"as" !',' !'}')? (NAME / STR) ("as" (NAME / STR))?
export_decl: decorator* 'export' ('default' (func / "abstract"? class / "interface" interface_rest / ("async" !NLB)? 'function' '*'? ID? sig EOS / e EOS) / '*' ("as" NAME)? "from" STR import_with? EOS / "type"? named ("from" STR import_with?)? EOS / "type"? '*' ("as" NAME)? "from" STR EOS / "as" "namespace" ID EOS / '=' e EOS / decl)
decl: var EOS / func / class / ts_decl
decorator: '@' ID ('.' NAME)* args?
ts_decl: "declare" (var EOS / "abstract"? class / 'function' '*'? ID sig EOS / ts_body / "global" block_items) / ts_body / ("async" !NLB)? 'function' '*'? ID sig EOS / "global" block_items
ts_body: "interface" interface_rest / "type" ID typeparams? '=' type EOS / 'const'? 'enum' ID '{' (enum_member (',' enum_member)* ','?)? '}' / ("namespace" / "module") (ID ('.' ID)* / STR) block_items / "abstract" class
block_items: '{' item* '}'
interface_rest: ID typeparams? ('extends' type (',' type)*)? object_type
enum_member: (NAME / STR) ('=' e)?
stmt: block / 'if' '(' es ')' stmt ('else' stmt)? / 'for' 'await'? '(' for_head ')' stmt / 'while' '(' es ')' stmt / 'do' stmt 'while' '(' es ')' ';'? / 'return' (!NLB !';' es)? EOS / 'break' (!NLB ID)? EOS / 'continue' (!NLB ID)? EOS / 'throw' !NLB es EOS / try / 'switch' '(' es ')' '{' case* '}' / 'debugger' EOS / ';' / func / class / ts_decl / var EOS / ID ':' stmt / 'with' '(' es ')' stmt / !'function' es EOS
block: '{' stmt* '}'
for_head: (var_kind pattern ann? / operand) ("of" / 'in') es / (var / es)? ';' es? ';' es?
var_kind: 'var' / 'let' / 'const' / 'await'? "using"
var: ('var' / 'let' / 'const') declarator (',' declarator)*
declarator: arrow_const / pattern '!'? ann? ('=' e)?
@arrow_const: FNAME ann? '=' arrow
try: 'try' block ('catch' ('(' pattern ann? ')')? block)? ('finally' block)?
case: ('case' es / 'default') ':' stmt*
@func: ("async" !NLB)? 'function' '*'? FNAME sig block
anon_func: "async"? 'function' '*'? ID? sig block
sig: typeparams? '(' params ')' ret?
params: (param (',' param)*)? ','?
param: decorator* access* '...'? (pattern / 'this') '?'? ann? ('=' e)?
access: ("public" / "private" / "protected" / "readonly" / "override") !(',' / ')' / ':' / '=' / '?')
pattern: ID / '[' (pattern_item? ',')* pattern_item? ']' / '{' (prop_pattern (',' prop_pattern)* ','?)? '}' / 'yield' / 'await'
pattern_item: '...'? (pattern / operand) ('=' e)?
prop_pattern: '...' (pattern / operand) / propname ':' (pattern / operand) ('=' e)? / ID ('=' e)?
class: decorator* 'class' (!'extends' !"implements" ID)? typeparams? ('extends' operand typeargs?)? ("implements" type (',' type)*)? '{' member* '}'
member: ';' / 'static'? block / "static" block / method / field
modifier: ("public" / "private" / "protected" / "readonly" / "override" / "abstract" / "static" / "declare" / "accessor" / "async") !('(' / '=' / ';' / '}' / ':' / '?' / '!') !('<' !'(')
@method: decorator* modifier* '*'? (("get" / "set") !('(' / '=' / ';' / '}' / ':' / '?' / '<'))? (PNAME / STR / NUM / '[' es ']') '?'? typeparams? '(' params ')' ret? (block / EOS)
field: decorator* modifier* (propname / '[' ID ':' type ']') ('?' / '!')? ann? ('=' e)? EOS
propname: NAME / STR / NUM / '[' es ']'
es: e (',' e)*
e: operand (binop operand / '?' e ':' e / as_type)*
binop: '+' / '-' / '*' / '/' / '%' / '**' / '&' / '|' / '^' / '&&' / '||' / '??' / '==' / '!=' / '===' / '!==' / '<<' / '<' '='? / '<=' / '>' '>'? '>'? ('=' / '==')? / 'instanceof' / 'in' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
as_type: !NLB ("as" / "satisfies") ('const' / type)
operand: arrow / prefix* primary postfix*
prefix: '!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' / 'yield' '*'? &(ID / NUM / STR / TPL / '(' / '[' / '{' / 'new' / 'this' / 'await' / '!' / '-' / 'null' / 'true' / 'false' / 'typeof') / cast
cast: '<' type '>'
arrow: ("async" !NLB)? (ID / typeparams? '(' params ')' ret?) '=>' (block / e)
postfix: '.' NAME / '?.' (NAME / '[' es ']' / args) / '[' es ']' / args / TPL / typeargs (args / TPL) / !NLB ('++' / '--') / !NLB '!' !'='
args: '(' ('...'? e (',' '...'? e)*)? ','? ')'
primary: anon_func / ID / NUM / STR / TPL / 'this' / 'super' / 'null' / 'true' / 'false' / '(' es ')' / array / object / class / 'new' new_target / 'import' ('.' NAME / args) / 'yield'
new_target: '.' NAME / 'new' new_target / (anon_func / ID / 'this' / '(' es ')' / class) ('.' NAME / '[' es ']')* typeargs? args?
array: '[' (('...'? e)? ',')* ('...'? e)? ']'
object: '{' (prop (',' prop)* ','?)? '}'
prop: '...' e / obj_method / propname ':' e / ID ('=' e)?
@obj_method: "async"? '*'? (("get" / "set") !('(' / ',' / ':' / '}' / '='))? (PNAME / STR / NUM / '[' es ']') typeparams? '(' params ')' ret? block
ann: ':' type
ret: ':' (("asserts")? (ID / 'this') "is" type / "asserts" ID / type)
typeparams: '<' ('const'? ("in" / 'in' / "out")? ID ('extends' type)? ('=' type)? ','?)+ '>'
typeargs: '<' type (',' type)* '>'
type: cond_type
cond_type: ("infer" ID / union) ('extends' union '?' type ':' type)?
union: ('|' / '&')? unary_type (('|' / '&') unary_type)*
unary_type: ("keyof" / "readonly" / "unique" / "infer") unary_type / 'new'? typeparams? '(' params ')' '=>' ret_type / atom ('[' type? ']')*
ret_type: "asserts" (ID / 'this') ("is" type)? / (ID / 'this') "is" type / type
atom: TPL / 'typeof' ID ('.' NAME)* typeargs? / (ID / 'void' / 'null' / 'this') ('.' NAME)* typeargs? / STR / '-'? NUM / 'true' / 'false' / '(' type ')' / '[' (('...'? (ID '?'? ':')? type '?'?) (',' '...'? (ID '?'? ':')? type '?'?)*)? ','? ']' / object_type / 'import' '(' STR ')' ('.' NAME)* typeargs?
object_type: '{' (type_member (';' / ',' / NLB / &'}'))* '}'
type_member: ("readonly" !(':' / '?'))? (('+' / '-')? "readonly")? ('new'? sig / (("get" / "set") !(':' / '?' / '('))? '[' ID (':' type / 'in' type ("as" type)?) ']' ('-' / '+')? '?'? ann? / (("get" / "set") !(':' / '?' / '(' / ';' / '}' / ','))? propname '?'? (sig / ann)?)
"""

JAVASCRIPT = r"""
fail: !ANY ANY
import_decl: 'import' !'(' !'.' (STR / import_clause "from" STR) import_with? EOS
spec: (NAME / STR) ("as" (NAME / STR))?
export_decl: decorator* 'export' ('default' (func / class / e EOS) / '*' ("as" NAME)? "from" STR import_with? EOS / named ("from" STR import_with?)? EOS / decl)
ts_decl: fail
ts_body: fail
access: fail
modifier: ("static" / "accessor" / "async") !('(' / '=' / ';' / '}')
@method: decorator* modifier* '*'? (("get" / "set") !('(' / '=' / ';' / '}'))? (PNAME / STR / NUM / '[' es ']') '(' params ')' block
param: decorator* '...'? pattern ('=' e)?
field: decorator* modifier* propname ('=' e)? EOS
declarator: arrow_const / pattern ('=' e)?
cast: fail
as_type: fail
ann: fail
ret: fail
typeparams: fail
typeargs: fail
postfix: '.' NAME / '?.' (NAME / '[' es ']' / args) / '[' es ']' / args / TPL / !NLB ('++' / '--')
class: decorator* 'class' (!'extends' ID)? ('extends' operand)? '{' member* '}'
"""

JAVA = r"""
start: (annotation* 'package' qname ';')? import* (type_decl / ';')* EOF / import* annotation* "open"? "module" qname '{' directive* '}' EOF
directive: "requires" ("transitive" !';' / 'static')* qname ';' / ("exports" / "opens") qname ("to" qname (',' qname)*)? ';' / "uses" qname ';' / "provides" qname "with" qname (',' qname)* ';'
import: 'import' 'static'? ID ('.' ID)* ('.' '*')? ';'
qname: ID ('.' ID)*
annotation: '@' !'interface' qname ('(' (element (',' element)* ','?)? ')')?
element: (ID '=')? element_value
element_value: annotation / '{' (element_value (',' element_value)*)? ','? '}' / e
modifier: annotation / 'public' / 'private' / 'protected' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' !'->' / "sealed" &(ID / 'class' / 'interface' / 'abstract' / 'public') / "non" '-' "sealed"
type_decl: modifier* ('class' ID typeparams? ('extends' type)? ('implements' types)? ("permits" types)? class_body / 'interface' ID typeparams? ('extends' types)? ("permits" types)? class_body / 'enum' ID ('implements' types)? enum_body / "record" ID typeparams? '(' params ')' ('implements' types)? class_body / '@' 'interface' ID class_body)
types: type (',' type)*
class_body: '{' member* '}'
enum_body: '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant: annotation* ID args? class_body?
member: ';' / 'static'? block / type_decl / method / ctor / field
@method: modifier* typeparams? modifier* type FNAME '(' params ')' ('[' ']')* ('throws' types)? (block / ('default' element_value)? ';')
@ctor: modifier* typeparams? FNAME ('(' params ')')? ('throws' types)? block
field: modifier* type vars ';'
vars: var_init (',' var_init)*
var_init: ID ('[' ']')* ('=' init)?
init: array_init / e
array_init: '{' (init (',' init)*)? ','? '}'
params: (param (',' param)*)?
param: modifier* type ('...')? (ID '.')? (ID / 'this') ('[' ']')*
typeparams: '<' annotation* ID ('extends' type ('&' type)*)? (',' annotation* ID ('extends' type ('&' type)*)?)* '>'
type: annotation* (prim / ID typeargs? ('.' annotation* ID typeargs?)*) (annotation* '[' ']')*
prim: 'int' / 'long' / 'short' / 'byte' / 'char' / 'boolean' / 'float' / 'double' / 'void'
typeargs: '<' (typearg (',' typearg)*)? '>'
typearg: annotation* '?' (('extends' / 'super') type)? / type
block: '{' stmt* '}'
stmt: block / ';' / 'if' '(' e ')' stmt ('else' stmt)? / 'for' '(' for_head ')' stmt / 'while' '(' e ')' stmt / 'do' stmt 'while' '(' e ')' ';' / 'return' e? ';' / 'break' ID? ';' / 'continue' ID? ';' / 'throw' e ';' / 'try' resources? block catch* ('finally' block)? / switch / 'synchronized' '(' e ')' block / 'assert' e (':' e)? ';' / "yield" !'=' !'.' !'(' e ';' / ID ':' stmt / type_decl / local ';' / e ';'
local: ('final' / annotation)* type vars
for_head: ('final' / annotation)* type ID ':' e / (local / e (',' e)*)? ';' e? ';' (e (',' e)*)?
resources: '(' resource (';' resource)* ';'? ')'
resource: local / e
catch: 'catch' '(' ('final' / annotation)* type ('|' type)* ID ')' block
switch: 'switch' '(' e ')' '{' ((label ':')+ stmt* / label '->' (block / 'throw' e ';' / e ';'))* '}'
label: 'case' ('default' / case_item) (',' ('default' / case_item))* ("when" e)? / 'default'
case_item: type ID &('->' / ':' / ',' / ID) / e_case
e_case: unary (binop unary)*
e: unary (binop unary / '?' e ':' e / 'instanceof' 'final'? type ID?)*
binop: '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '&&' / '||' / '==' / '!=' / '<<' / '<' / '<=' / '>' '>'? '>'? ('=' / '==')? / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<='
unary: ('!' / '~' / '+' / '-' / '++' / '--') unary / lambda / '(' prim ('[' ']')* ')' unary / '(' type ('&' type)* ')' &(ID / STR / CHR / NUM / '(' / '!' / '~' / 'new' / 'this' / 'super' / 'null' / 'true' / 'false' / 'switch') unary / primary postfix*
lambda: (ID / '(' lambda_params ')') '->' (block / e)
lambda_params: (ID (',' ID)* !ID / params)
primary: NUM / STR / CHR / 'true' / 'false' / 'null' / 'this' args? / 'super' args? / 'new' new_rest / switch / type ('::' (ID / 'new') / '.' 'class') / ID args? / '(' e ')' / array_init
new_rest: annotation* (prim / ID typeargs? ('.' ID typeargs?)*) (dims array_init? / args class_body?)
dims: ('[' e? ']')+
postfix: '.' (typeargs? ID args? / 'new' new_rest / 'this' / 'super' args? / 'class') / '[' e ']' / '++' / '--' / '::' typeargs? (ID / 'new')
args: '(' (e (',' e)*)? ')'
"""

CSHARP = r"""
start: ('extern' ID ID ';')* using_dir* global_attr* (ns_file / unit*) EOF
using_dir: "global"? 'using' 'static'? (ID '=')? type ';'
global_attr: '[' ID ':' attr_list ']'
attr_list: attr (',' attr)* ','?
attr: qname typeargs? ('(' (arg_attr (',' arg_attr)*)? ')')?
arg_attr: (ID ('=' / ':'))? e
attrs: ('[' (ID / 'return' / 'event') ':' attr_list ']' / '[' attr_list ']')+
ns_file: 'namespace' qname ';' using_dir* unit*
unit: 'namespace' qname '{' using_dir* unit* '}' ';'? / type_decl / stmt
qname: (ID '::')? ID ('.' ID)*
modifier: 'public' / 'private' / 'protected' / 'internal' / 'static' / 'abstract' / 'sealed' / 'virtual' / 'override' / 'readonly' / 'const' / 'extern' / 'unsafe' / 'volatile' / 'new' / "async" !'(' !'=' / "partial" &('class' / 'struct' / 'interface' / ID / 'void') / "required" &ID / 'ref' / 'fixed'
type_decl: attrs? modifier* (('class' / 'struct' / 'interface' / "record" ('class' / 'struct')?) ID typeparams? ('(' params ')')? (':' base (',' base)*)? where* (class_body ';'? / ';') / 'enum' ID (':' type)? '{' (enum_item (',' enum_item)* ','?)? '}' ';'? / 'delegate' type ID typeparams? '(' params ')' where* ';')
base: type args?
enum_item: attrs? ID ('=' e)?
where: "where" ID ':' constraint (',' constraint)*
constraint: 'new' '(' ')' / 'class' '?'? / 'struct' / 'default' / type
typeparams: '<' attrs? ('in' / 'out')? ID (',' attrs? ('in' / 'out')? ID)* '>'
class_body: '{' member* '}'
member: type_decl / event / operator / method / ctor / indexer / property / field
event: attrs? modifier* 'event' type (ID ('.' ID)* '{' accessor+ '}' / vars ';')
operator: attrs? modifier* (('implicit' / 'explicit') 'operator' type / type 'operator' ('+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '!' / '~' / '++' / '--' / '==' / '!=' / '<<' / '<' / '<=' / '>' '>'? '='? / 'true' / 'false')) '(' params ')' body
@method: attrs? modifier* type (ID typeargs? '.')* FNAME typeparams? '(' params ')' where* body
@ctor: attrs? modifier* '~'? FNAME '(' params ')' (':' ('base' / 'this') args)? body
indexer: attrs? modifier* type (ID '.')* 'this' '[' params ']' prop_body
property: attrs? modifier* type (ID typeargs? '.')* ID prop_body
prop_body: '{' accessor+ '}' ('=' init ';')? / '=>' e ';'
accessor: attrs? modifier* ("get" / "set" / "init" / "add" / "remove") body
field: attrs? modifier* type vars ';'
vars: var_init (',' var_init)*
var_init: ID ('[' e ']')? ('=' init)?
init: array_init / e
array_init: '{' (init (',' init)*)? ','? '}'
body: block / '=>' e ';' / ';'
params: (param (',' param)*)?
param: attrs? ('this' / 'ref' / 'out' / 'in' / 'params' / "scoped")* type ID ('=' e)?
prim: 'int' / 'uint' / 'long' / 'ulong' / 'short' / 'ushort' / 'byte' / 'sbyte' / 'char' / 'bool' / 'float' / 'double' / 'decimal' / 'string' / 'object' / 'void'
type: 'ref'? 'readonly'? (prim / tuple_type / (ID '::')? ID typeargs? ('.' ID typeargs?)*) ('?' / '*' / '[' ','* ']')*
type_is: (prim / tuple_type / (ID '::')? ID typeargs? ('.' ID typeargs?)*) ('[' ','* ']')*
tuple_type: '(' type ID? (',' type ID?)+ ')'
typeargs: '<' (type (',' type)* / ','*) '>'
block: '{' stmt* '}'
stmt: block / ';' / 'if' '(' e ')' stmt ('else' stmt)? / 'for' '(' (local / e (',' e)*)? ';' e? ';' (e (',' e)*)? ')' stmt / 'await'? "await"? 'foreach' '(' (type ID / 'var'? "var" '(' ID (',' ID)* ')' / '(' type ID (',' type ID)+ ')') 'in' e ')' stmt / 'while' '(' e ')' stmt / 'do' stmt 'while' '(' e ')' ';' / 'return' e? ';' / 'break' ';' / 'continue' ';' / 'throw' e? ';' / 'goto' ('case' e / 'default' / ID) ';' / try / 'switch' '(' e ')' '{' section* '}' / "await"? 'using' ('(' (local / e) ')' stmt / local ';') / 'lock' '(' e ')' stmt / ('checked' / 'unchecked' / 'unsafe') block / 'fixed' '(' local ')' stmt / "yield" ('return' e / 'break') ';' / ID ':' stmt / local_func / local ';' / e ';'
try: 'try' block ('catch' ('(' type ID? ')')? ("when" '(' e ')')? block)* ('finally' block)?
section: (('case' pattern ("when" e)? / 'default') ':')+ stmt+
@local_func: attrs? ('static' / "async" / 'unsafe' / 'extern')* type FNAME typeparams? '(' params ')' where* body
local: 'const'? type vars
pattern: pattern_and ("or" pattern_and)*
pattern_and: pattern_not ("and" pattern_not)*
pattern_not: "not" pattern_not / ('<' '='? / '<=' / '>' '='?) unary / '(' pattern ')' / "var" ID / type_is? '{' (ID ('.' ID)* ':' pattern (',' ID ('.' ID)* ':' pattern)* ','?)? '}' ID? / type_is ID &(')' / ':' / '&&' / '||' / '=>' / ';' / '?' / ID / ',') / unary (('+' / '-' / '*' / '|') unary)*
e: unary (binop unary / '?' e ':' e / 'is' pattern / 'as' type_is / 'switch' '{' (arm (',' arm)* ','?)? '}' / "with" array_init)*
arm: pattern ("when" e)? '=>' e
binop: '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '&&' / '||' / '??' / '==' / '!=' / '<<' / '<' / '<=' / '>' '>'? '='? / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '??=' / '..'
unary: ('!' / '~' / '+' / '-' / '++' / '--' / '&' / '*' / '^' / '..') unary / "await" !('.' / '=' / ';' / ')') unary / 'throw' e / 'ref' unary / lambda / '(' type ')' &(ID / STR / CHR / NUM / '(' / '!' / '~' / 'new' / 'this' / 'base' / 'null' / 'true' / 'false' / prim / 'typeof' / 'default') unary / query / primary postfix*
lambda: ("async" / 'static')* (ID / '(' lambda_params ')') '=>' (block / e) / "async"? 'delegate' ('(' params ')')? block
lambda_params: (ID (',' ID)* !ID / params)
query: "from" range 'in' e clause+
range: type ID / ID
clause: "from" range 'in' e / "where" e / "let" ID '=' e / "join" range 'in' e "on" e "equals" e ("into" ID)? / "orderby" e ("ascending" / "descending")? (',' e ("ascending" / "descending")?)* / "select" e / "group" e "by" e / "into" ID
primary: NUM / STR / CHR / 'true' / 'false' / 'null' / 'this' / 'base' / 'new' new_rest / 'typeof' '(' type ')' / 'sizeof' '(' type ')' / 'default' ('(' type ')')? / ('checked' / 'unchecked') '(' e ')' / "nameof" '(' e ')' / 'stackalloc' new_rest / prim / (ID '::')? ID typeargs &('(' / '.' / ')' / ';' / ',') / ID / '(' e (',' e)* ')' / '(' (ID ':')? e (',' (ID ':')? e)+ ')'
new_rest: '[' ','* ']' array_init / array_init / args object_init? / type_new (args object_init? / ('[' e (',' e)* ']') ('[' ','* ']')* array_init? / ('[' ','* ']')+ array_init / object_init)
type_new: (prim / (ID '::')? ID typeargs? ('.' ID typeargs?)*) '?'?
object_init: '{' ((ID / '[' e ']') '=' init (',' (ID / '[' e ']') '=' init)* ','? / (init (',' init)*)? ','?) '}'
postfix: ('.' / '->' / '?.') ID typeargs? / '?' '[' arg_list ']' / '[' arg_list ']' / args / '++' / '--' / '!' !'='
args: '(' arg_list? ')'
arg_list: arg (',' arg)*
arg: (ID ':')? ('ref' / 'in' / 'out')? (type ID &(')' / ',') / e)
"""

C = r"""
start: unit+ EOF
unit: ';' / funcdef / decl / static_assert
static_assert: '_Static_assert' '(' e ',' STR+ ')' ';'
@funcdef: specs declarator_fn block
declarator_fn: pointer* attribute* (FNAME / '(' declarator_fn ')') fn_suffix suffix* attribute*
fn_suffix: '(' params ')'
decl: storage* specs (init_decl (',' init_decl)*)? ';'
storage: 'typedef' / 'extern' / 'static' / 'auto' / 'register' / '_Thread_local' / 'inline' / '_Noreturn' / attribute / '_Alignas' '(' (typename / e) ')'
attribute: "__attribute__" '(' '(' balanced* ')' ')' / "__declspec" '(' balanced* ')' / "__extension__"
balanced: '(' balanced* ')' / !'(' !')' ANY
qual: 'const' / 'volatile' / 'restrict' / '_Atomic' !'(' / storage
specs: qual* (basic (basic / qual)* / tagged qual* / ID qual*)
basic: 'int' / 'char' / 'short' / 'long' / 'float' / 'double' / 'void' / 'signed' / 'unsigned' / '_Bool' / '_Complex' / '_Atomic' '(' typename ')'
tagged: ('struct' / 'union') attribute* (ID ('{' field* '}')? / '{' field* '}') / 'enum' (ID ('{' enumerators '}')? / '{' enumerators '}')
enumerators: ID ('=' e)? (',' ID ('=' e)?)* ','?
field: ';' / static_assert / specs (field_decl (',' field_decl)*)? ';'
field_decl: declarator (':' e)? / ':' e
init_decl: declarator attribute* ('=' init)?
declarator: pointer* attribute* (ID / '(' declarator ')') suffix* attribute*
pointer: '*' ('const' / 'volatile' / 'restrict')*
suffix: '[' ('static' / 'const' / 'restrict')* ('*' &']' / e)? ']' / '(' params ')'
params: ('void' &')' / param (',' param)* (',' '...')?)?
param: specs (declarator / abstract)?
abstract: pointer+ abstract_rest? / abstract_rest
abstract_rest: ('(' abstract ')')? suffix+ / '(' abstract ')'
typename: specs abstract?
init: '{' (designated (',' designated)* ','?)? '}' / assign
designated: (('.' ID / '[' e ']')+ '=')? init
block: '{' stmt* '}'
stmt: block / ';' / 'if' '(' e ')' stmt ('else' stmt)? / 'for' '(' (decl / e? ';') e? ';' e? ')' stmt / 'while' '(' e ')' stmt / 'do' stmt 'while' '(' e ')' ';' / 'switch' '(' e ')' stmt / 'case' e ('...' e)? ':' stmt? / 'default' ':' stmt? / 'return' e? ';' / 'break' ';' / 'continue' ';' / 'goto' ID ';' / ID ':' stmt / static_assert / decl / e ';'
e: assign (',' assign)*
assign: unary (binop unary / '?' e ':' assign)*
binop: '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '&&' / '||' / '==' / '!=' / '<<' / '>>' / '<' / '<=' / '>' / '>=' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>='
unary: ('!' / '~' / '+' / '-' / '++' / '--' / '&' / '*') unary / 'sizeof' ('(' typename ')' / unary) / '_Alignof' '(' typename ')' / '(' typename ')' ('{' (designated (',' designated)* ','?)? '}' postfix* / unary) / primary postfix*
primary: ID / NUM / CHR / STR+ / '(' e ')' / '(' block ')' / '_Generic' '(' assign (',' (typename / 'default') ':' assign)+ ')'
postfix: '[' e ']' / '(' (assign (',' assign)*)? ')' / '.' ID / '->' ID / '++' / '--'
"""

CPP = r"""
start: unit* EOF
unit: ';' / 'namespace' attr* (ID ('::' 'inline'? ID)*)? '{' unit* '}' / 'inline' 'namespace' ID '{' unit* '}' / 'namespace' ID '=' qid ';' / 'extern' STR ('{' unit* '}' / unit) / template unit_member / using / static_assert / funcdef / decl
unit_member: template unit_member / concept / using / 'friend' decl / funcdef / ctor_def / decl
concept: 'concept' ID '=' e ';'
template: 'template' ('<' (tparam (',' tparam)*)? '>')? requires?
tparam: template? ('typename' / 'class') '...'? ID? ('=' type)? / specs (declarator / abstract)? ('=' unary)? / qid '...'? ID ('=' type)?
requires: 'requires' unary (('&&' / '||') unary)*
using: 'using' ('namespace' qid / ID attr* '=' type / 'enum'? 'typename'? qid (',' qid)*) ';'
static_assert: 'static_assert' '(' assign (',' STR+)? ')' ';'
attr: '[' '[' balanced* ']' ']' / "__attribute__" '(' balanced* ')' / 'alignas' '(' balanced* ')'
balanced: '(' balanced* ')' / '[' balanced* ']' / '{' balanced* '}' / !'(' !')' !'[' !']' !'{' !'}' ANY
@funcdef: specs declarator_fn fn_tail (block / try_body / '=' ('default' / 'delete') ';')
declarator_fn: pointer* attr* (fn_name / '(' declarator_fn ')') '(' params ')'
fn_name: (qscope)? (FNAME / operator_name)
qscope: ('::')? (ID targs? '::')+
operator_name: 'operator' ('new' ('[' ']')? / 'delete' ('[' ']')? / '(' ')' / '[' ']' / '->*' / '->' / '<=>' / '++' / '--' / '==' / '!=' / '<=' / '>' '>'? '='? / '<<=' / '<<' / '&&' / '||' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '!' / '~' / '=' / '<' / ',' / STR ID? / type)
fn_tail: ('const' / 'volatile' / '&&' / '&' / 'noexcept' ('(' e ')')? / 'throw' '(' ')' / "override" / "final" / attr)* ('->' type)? requires?
try_body: 'try' (':' inits)? block catch+
@ctor_def: member_spec* qscope? '~'? FNAME '(' params ')' fn_tail (':' inits)? (block / try_body / '=' ('default' / 'delete') ';' / ';')
conversion: member_spec* qscope? 'operator' type '(' ')' fn_tail (block / ';' / '=' ('default' / 'delete') ';')
inits: mem_init (',' mem_init)*
mem_init: qid ('(' arglist? ')' / braces) '...'?
member_spec: 'explicit' ('(' e ')')? / 'inline' / 'constexpr' / 'consteval' / 'virtual' / 'static' / 'friend' / attr
decl: specs (init_decl (',' init_decl)*)? ';' / 'auto' ('&' / '&&')? '[' ID (',' ID)* ']' '=' e ';'
storage: 'typedef' / 'extern' / 'static' / 'thread_local' / 'register' / 'inline' / 'virtual' / 'explicit' / 'friend' / 'mutable' / 'constexpr' / 'consteval' / 'constinit' / attr
qual: 'const' / 'volatile' / storage
specs: qual* (basic (basic / qual)* / tagged qual* / ('auto' / 'decltype' '(' e ')') qual* / 'typename'? qid '...'? qual*)
basic: 'int' / 'char' / 'short' / 'long' / 'float' / 'double' / 'void' / 'signed' / 'unsigned' / 'bool' / 'wchar_t' / 'char8_t' / 'char16_t' / 'char32_t'
qid: '::'? 'template'? ID targs? ('::' 'template'? ('~'? ID) targs?)*
targs: '<' (targ (',' targ)*)? '>'
targ: (type '...'? &(',' / '>') / shift)
shift: unary (('+' / '-' / '*' / '/' / '%' / '&' / '|' / '==' / '!=' / '&&' / '||') unary)* '...'?
tagged: ('class' / 'struct' / 'union') attr* ((qid "final"?)? (':' base (',' base)*)? '{' member* '}' / qid) / 'enum' ('class' / 'struct')? attr* ID? (':' type)? '{' (enumerator (',' enumerator)* ','?)? '}' / 'enum' ('class' / 'struct')? qid (':' type)?
base: ('virtual' / 'public' / 'protected' / 'private')* qid '...'?
enumerator: ID attr* ('=' shift_e)?
shift_e: assign
member: ('public' / 'protected' / 'private' / ID &(':' !':')) ':' / ';' / template unit_member / using / static_assert / 'friend' (funcdef / decl) / funcdef / ctor_def / conversion / field
field: specs (field_decl (',' field_decl)*)? ';'
field_decl: declarator fn_tail (':' e)? ('=' init / braces / '=' ('default' / 'delete'))? / ':' e
init_decl: declarator fn_tail ('=' init / braces / '(' arglist ')')?
declarator: pointer* attr* '...'? (qscope? (ID / operator_name) / '(' declarator ')') attr* suffix*
pointer: ('*' / '&&' / '&' / qscope '*') ('const' / 'volatile')*
suffix: '[' e? ']' / '(' params ')'
params: ('void' &')' / param (',' param)* (',' '...')? / '...')?
param: attr* ('this' &ID)? specs '...'? (declarator / abstract)? ('=' init)?
abstract: pointer+ '...'? abstract_rest? / abstract_rest
abstract_rest: ('(' abstract ')')? suffix+ / '(' abstract ')'
type: specs abstract?
init: braces / assign
braces: '{' (designated (',' designated)* ','?)? '}'
designated: ('.' ID ('=' / &'{'))? (init '...'?)
block: '{' stmt* '}'
stmt: attr* stmt_body
stmt_body: block / ';' / 'if' 'constexpr'? '(' cond ')' stmt ('else' stmt)? / 'for' '(' for_head ')' stmt / 'while' '(' cond ')' stmt / 'do' stmt 'while' '(' e ')' ';' / 'switch' '(' cond ')' stmt / 'case' e ('...' e)? ':' stmt? / 'default' ':' stmt? / 'return' (init (',' init)*)? ';' / ('co_return' / 'co_yield') init? ';' / 'break' ';' / 'continue' ';' / 'goto' ID ';' / 'try' block catch+ / ID ':' !':' stmt / using / static_assert / decl / e ';'
cond: (decl / e ';')? (specs declarator ('=' init / braces) / e)
for_head: (decl / e ';')? specs (pointer* '[' ID (',' ID)* ']' / declarator) ':' init / (decl / e? ';') e? ';' e?
catch: 'catch' '(' ('...' / type declarator? / param) ')' block
e: assign (',' assign)*
assign: unary (binop unary / '?' e ':' assign / ('=' / '+=' / 'or' / 'and') braces)* / 'throw' assign? / 'co_yield' assign
binop: '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '&&' / '||' / '==' / '!=' / '<=>' / '<<' / '<' / '<=' / '>' '>'? '='? / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / 'and' / 'or' / 'xor' / 'bitand' / 'bitor' / '.*' / '->*'
unary: ('!' / '~' / '+' / '-' / '++' / '--' / '&' / '&&' / '*' / 'not' / 'compl' / 'co_await') unary / 'sizeof' ('...' '(' ID ')' / '(' type ')' / unary) / 'alignof' '(' type ')' / 'noexcept' '(' e ')' / '::'? 'new' ('(' arglist ')')? ('(' type ')' / new_type) ('(' arglist? ')' / braces)? postfix* / '::'? 'delete' ('[' ']')? unary / '(' type ')' &(ID / NUM / STR / CHR / '(' / 'this' / 'new' / 'sizeof' / '-' / '*' / '&' / '!' / '~' / 'nullptr' / 'true' / 'false' / '::') unary / primary postfix*
new_type: specs pointer* ('[' e? ']')*
primary: lambda / NUM / CHR / (STR ID?)+ / 'this' / 'nullptr' / 'true' / 'false' / ('static_cast' / 'dynamic_cast' / 'const_cast' / 'reinterpret_cast') '<' type '>' '(' e ')' / 'typeid' '(' (type / e) ')' / 'requires' ('(' params ')')? '{' balanced* '}' / qid braces / basic+ ('(' arglist? ')' / braces) / 'typename' qid ('(' arglist? ')' / braces) / qid_e / operator_name / 'decltype' '(' e ')' / '(' e ')' / '(' fold ')'
fold: unary? binop? '...' (binop unary)?
qid_e: '::'? ID (targs &('(' / '::' / '{' / ')' / ';' / ','))? ('::' 'template'? '~'? (ID / operator_name) (targs &('(' / '::' / '{' / ')' / ';' / ','))?)*
lambda: '[' captures? ']' ('<' tparam (',' tparam)* '>')? attr* ('(' params ')')? ('mutable' / 'constexpr' / 'static' / 'noexcept' ('(' e ')')?)* ('->' type)? requires? block
captures: capture (',' capture)*
capture: ('&' / '=') &(']' / ',') / '*'? 'this' / '&'? '...'? ID '...'? ('=' init / braces)?
postfix: '[' e? ']' / '(' arglist? ')' / braces / ('.' / '->') 'template'? ('~'? qid_e / operator_name) / '++' / '--'
arglist: init '...'? (',' init '...'?)*
"""

GO = r"""
start: 'package' ID ';' (import ';')* (top ';')* EOF
import: 'import' ('(' (import_spec ';')* import_spec? ')' / import_spec)
import_spec: ('.' / ID)? STR
top: func / method / var / const / type_decl
@func: 'func' FNAME typeparams? sig block?
@method: 'func' '(' params ')' FNAME sig block?
typeparams: '[' ID (',' ID)* constraint (',' ID (',' ID)* constraint)* ','? ']'
constraint: '~'? type ('|' '~'? type)*
sig: '(' params ')' result?
result: '(' params ')' / type
params: (param (',' param)* ','?)?
param: ID (',' ID)* '...'? type / '...'? type
var: 'var' ('(' (var_spec ';')* var_spec? ')' / var_spec)
var_spec: ID (',' ID)* (type ('=' exprs)? / '=' exprs)
const: 'const' ('(' (const_spec ';')* const_spec? ')' / const_spec)
const_spec: ID (',' ID)* (type? '=' exprs)?
type_decl: 'type' ('(' (type_spec ';')* type_spec? ')' / type_spec)
type_spec: ID '=' type / ID typeparams type / ID type
type: '*' type / '[' ('...' / e)? ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' sig / 'struct' '{' (field ';')* field? '}' / 'interface' '{' (elem ';')* elem? '}' / '(' type ')' / ID ('.' ID)? ('[' type (',' type)* ']')?
field: ID (',' ID)* type STR? / '*'? ID ('.' ID)? ('[' type (',' type)* ']')? STR?
elem: ID sig / constraint
block: '{' stmts '}'
stmts: (stmt? ';')* stmt?
stmt: block / if / for / switch / select / 'return' exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / ('go' / 'defer') e / var / const / type_decl / ID ':' !'=' stmt? / simple
simple: exprs (':=' exprs / assign_op exprs / '++' / '--' / '<-' e)?
simple_n: exprs_n (':=' 'range'? exprs_n / assign_op 'range'? exprs_n / '++' / '--' / '<-' e_n)?
assign_op: '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
if: 'if' (simple_n? ';')? e_n block ('else' (if / block))?
for: 'for' (block / 'range' e_n block / simple_n? ';' e_n? ';' simple_n? block / simple_n block)
switch: 'switch' (simple_n? ';')? (ID ':=' e_n '.' '(' 'type' ')' / simple_n)? '{' (('case' types_or_exprs / 'default') ':' stmts)* '}'
types_or_exprs: (type &(',' / ':') / e) (',' (type &(',' / ':') / e))*
select: 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
exprs: e (',' e)*
exprs_n: e_n (',' e_n)*
e: unary (binop unary)*
e_n: unary_n (binop unary_n)*
binop: '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '&&' / '||' / '==' / '!=' / '<<' / '>>' / '<' / '<=' / '>' / '>=' / '&^'
unary: ('!' / '+' / '-' / '^' / '*' / '&' / '<-') unary / operand (literal / postfix)*
unary_n: ('!' / '+' / '-' / '^' / '*' / '&' / '<-') unary_n / operand_n postfix*
operand: NUM / STR / CHR / 'func' sig block / ID ('.' ID)? '[' type (',' type)* ']' &('{' / '(') / ID / typed literal / '(' e ')' / type
operand_n: NUM / STR / CHR / 'func' sig block / ID / typed_lit literal / '(' e ')' / type
typed: &('[' / 'map' / 'struct') type
typed_lit: &('[' / 'map' / 'struct') type
literal: '{' (element (',' element)* ','?)? '}'
element: (element_value ':')? element_value
element_value: literal / e
postfix: '.' (ID / '(' ('type' / type) ')') / '[' (e? (':' e? (':' e)?)? / type (',' type)*) ']' / '(' (arg (',' arg)* ','?)? ')'
arg: (e / type) '...'?
"""

RUST = r"""
start: inner_attr* item* EOF
inner_attr: '#' '!' '[' tree* ']'
attr: '#' '[' tree* ']'
tree: '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !'(' !')' !'[' !']' !'{' !'}' ANY
vis: 'pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')?
item: attr* vis? item_body / attr* macro_item
item_body: 'use' use_tree ';' / 'mod' ID (';' / '{' inner_attr* item* '}') / 'extern' 'crate' ID ('as' ID)? ';' / struct / enum / "union" ID generics? '{' fields '}' / trait / impl / 'unsafe'? 'extern' STR? '{' extern_item* '}' / 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';' / 'const' (ID / "_") ':' type ('=' e)? ';' / 'static' 'mut'? ID ':' type ('=' e)? ';' / fn
extern_item: attr* vis? (fn / 'static' 'mut'? ID ':' type ';' / 'type' ID ';')
macro_item: path '!' ID? ('{' tree* '}' / '(' tree* ')' ';' / '[' tree* ']' ';')
use_tree: '::'? ((use_seg '::')* ('*' / '{' (use_tree (',' use_tree)* ','?)? '}') / use_seg ('::' use_seg)* ('as' ID)?)
use_seg: ID / 'crate' / 'self' / 'super' / 'Self'
@fn: attr* vis? ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' FNAME generics? '(' fn_params ')' ('->' type)? where? (block / ';')
fn_params: (fn_param (',' fn_param)* ','?)?
fn_param: attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' type)? / pattern ':' type / '...' / type)
struct: 'struct' ID generics? where? ('{' fields '}' / '(' tuple_fields ')' where? ';' / ';')
fields: (field (',' field)* ','?)?
field: attr* vis? ID ':' type
tuple_fields: (attr* vis? type (',' attr* vis? type)* ','?)?
enum: 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}'
variant: attr* vis? ID ('{' fields '}' / '(' tuple_fields ')')? ('=' e)?
trait: 'unsafe'? "auto"? 'trait' ID generics? (':' bounds?)? where? '{' member* '}'
impl: 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' inner_attr* member* '}'
member: fn / attr* vis? "default"? ('type' ID generics? (':' bounds)? where? ('=' type)? where? ';' / 'const' ID ':' type ('=' e)? ';' / fn) / attr* macro_item
generics: '<' (generic (',' generic)* ','?)? '>'
generic: attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' ID ':' type ('=' (block / NUM / ID))? / ID (':' bounds?)? ('=' type)?)
bounds: bound ('+' bound)* '+'?
bound: LIFE / '(' bound ')' / '?'? for_life? path / '~'? 'const' path
for_life: 'for' generics
where: 'where' (pred (',' pred)* ','?)?
pred: LIFE ':' LIFE ('+' LIFE)* / for_life? type ':' bounds?
type: '&' LIFE? 'mut'? type / '&&' LIFE? 'mut'? type / '*' ('const' / 'mut') type / '[' type (';' e)? ']' / '(' (type (',' type)* ','?)? ')' / '!' / 'impl' bounds / 'dyn' bounds / for_life? ('unsafe' / 'extern' STR?)* 'fn' '(' (attr* ((ID / "_") ':')? type (',' attr* ((ID / "_") ':')? type)* ','?)? ')' ('->' type)? / '<' type ('as' path)? '>' '::' path / "_" / path '!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / for_life? path
path: '::'? path_seg ('::' path_seg)*
path_seg: (ID / 'self' / 'Self' / 'super' / 'crate') ('::'? path_args / '(' (type (',' type)* ','?)? ')' ('->' type)?)? / path_args
path_args: '<' (path_arg (',' path_arg)* ','?)? '>'
path_arg: LIFE / ID path_args? ('=' type / ':' bounds) / type / NUM / STR / CHR / '-' NUM / block / 'true' / 'false'
pattern: '|'? pattern_one ('|' pattern_one)*
pattern_one: '&' 'mut'? pattern_one / '&&' 'mut'? pattern_one / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / '..' !NUM / ('ref')? 'mut'? ID '@' pattern_one / 'ref' 'mut'? ID / 'mut' ID / range_pattern / path '!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / (path / '<' type ('as' path)? '>' '::' path) ('{' (field_pattern (',' field_pattern)* ','?)? '}' / '(' (pattern (',' pattern)* ','?)? ')')? / "_"
range_pattern: bound_value (('..=' / '...' / '..') (bound_value / path)?)? / ('..=' / '..') bound_value
bound_value: '-'? NUM / STR / CHR / 'true' / 'false' / path &('..=' / '..' / '...')
field_pattern: attr* ('..' / (ID / NUM) ':' pattern / 'ref'? 'mut'? ID)
block: '{' inner_attr* stmt* e? '}'
stmt: ';' / attr* 'let' pattern (':' type)? ('=' e ('else' block)?)? ';' / item_stmt / attr* block_e !('.' / '?') / path '!' ID? '{' tree* '}' !('.' / '?') / attr* e ';'
item_stmt: attr* vis? ('use' use_tree ';' / 'mod' ID '{' item* '}' / struct / enum / trait / impl / 'const' (ID / "_") ':' type '=' e ';' / 'static' 'mut'? ID ':' type '=' e ';' / 'type' ID generics? '=' type ';' / fn) / fn
block_e: (LIFE ':')? ('unsafe' block / 'loop' block / 'while' cond block / 'for' pattern 'in' e_ns block / block) / if / match / 'async' 'move'? block / 'const' block
cond: e_ns
if: 'if' cond block ('else' (if / block))?
match: 'match' e_ns '{' inner_attr* (arm)* '}'
arm: attr* pattern ('if' e)? '=>' (block ','? !('.' / '?' / binop) / e (',' / &'}') / block_e ','?)
e: range_start? unary (binop unary / 'as' type / ('..=' / '..') unary?)* / ('..=' / '..') unary? / '..'
range_start: ('..=' / '..') &(NUM / ID / '(')
e_ns: unary_ns (binop unary_ns / 'as' type / ('..=' / '..') unary_ns?)* / ('..=' / '..') unary_ns?
binop: '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '&&' / '||' / '==' / '!=' / '<' '<' / '<' '<=' / '<' / '<=' / '>' '>'? '='? / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^='
unary: ('!' / '-' / '*' / '&' 'mut'? / '&&' 'mut'? / '&' "raw" ('const' / 'mut')) unary / 'let' pattern '=' unary / primary postfix*
unary_ns: ('!' / '-' / '*' / '&' 'mut'? / '&&' 'mut'?) unary_ns / 'let' pattern '=' unary_ns / primary_ns postfix*
primary: closure / jump / block_e / struct_lit / common
primary_ns: closure / jump / if / match / 'unsafe' block / common
common: NUM / STR / CHR / 'true' / 'false' / path '!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / '(' (e (',' e)* ','?)? ')' / '[' (e (';' e / (',' e)* ','?))? ']' / '<' type ('as' path)? '>' '::' path_e / path_e
path_e: '::'? seg_e ('::' seg_e)*
seg_e: (ID / 'self' / 'Self' / 'super' / 'crate') / path_args
struct_lit: path_e '{' (field_init (',' field_init)* ','?)? '}'
field_init: attr* ('..' e? / (ID / NUM) (':' e)?)
closure: 'static'? 'async'? 'move'? ('||' / '|' (closure_param (',' closure_param)* ','?)? '|') ('->' type block / e)
closure_param: attr* pattern_one (':' type)?
jump: 'return' e? / 'break' LIFE? (!'{' e)? / 'continue' LIFE? / 'yield' e?
postfix: '?' / '.' ('await' / NUM / ID ('::' path_args)?) / '(' (e (',' e)* ','?)? ')' / '[' e ']'
"""

RUBY = r"""
start: stmts EOF
stmts: sep* (stmt (sep+ stmt)*)? sep*
sep: NL / ';'
nl: NL*
stmt: 'alias' ANY ANY / 'undef' NAME (',' NAME)* / ('BEGIN' / 'END') '{' stmts '}' / expr_stmt modifier*
modifier: ('if' / 'unless' / 'while' / 'until' / 'rescue') nl expr_stmt
expr_stmt: not_stmt (('and' / 'or') nl not_stmt)*
not_stmt: 'not' not_stmt / massign / command / e
massign: mlhs '=' nl mrhs
mlhs: mitem (',' mitem)+ ','? / '*' target / mitem ',' &'='
mitem: '*' target? / '(' mlhs ')' / target
target: ID &(',' / '=' / ')' / 'in' / '|') / primary postfix*
mrhs: ('*'? e) (',' '*'? e)*
command: chain &cmd_start cmd_args block_do?
chain: (ID / 'self' / STR / 'super' / 'yield') (('.' / '&.' / '::') NAME args_adj? / args_adj / ADJ '[' index ']')*
cmd_start: ID / STR / NUM / 'nil' / 'true' / 'false' / 'self' / '->' / 'not' / 'defined?' / 'super' / '__FILE__' / '__method__' / 'def' / UNA ('-' / '*' / '&' / '[' / '::' / '**' / '!')
cmd_args: arg (',' nl arg)*
arg: ('*' / '**' / '&') !NLB e? / NAME ':' !(':' ADJ) nl (e / &(',' / ')' / NL)) / STR ':' e / command / e ('=>' nl e)?
e: operand (binop nl operand / '?' nl e nl ':' nl e / assign_op nl (massign_rhs / command / e) / ('..' / '...') operand? / 'rescue' e)*
massign_rhs: ('*'? e) (',' '*'? e)+ 
assign_op: '=' !'=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '||=' / '&&=' / '|=' / '&=' / '^=' / '<<=' / '>>='
binop: '+' / '-' / '*' / '/' / '%' / '**' / '&' / '|' / '^' / '&&' / '||' / '<=>' / '===' / '==' / '!=' / '=~' / '!~' / '<<' / '>>' / '<' / '<=' / '>' / '>='
operand: ('!' / '-' / '+' / '~' / '*' / '**' / '&' / 'defined?' / 'not') operand / primary postfix*
postfix: ('.' / '&.') nl (NAME / '(') args_adj? / '::' NAME args_adj? / args_adj / '[' index ']' / block_brace / block_do_here
args_adj: ADJ args_paren
args_paren: '(' nl (arg (nl ',' nl arg)* nl ','?)? nl ')'
index: nl (arg (nl ',' nl arg)* nl ','?)? nl
block_brace: '{' block_params? stmts '}'
block_do: 'do' block_params? body 'end'
block_do_here: 'do' block_params? body 'end'
block_params: nl '|' (bparam (',' nl bparam)* ','?)? (';' ID (',' ID)*)? '|'
bparam: ('*' / '**' / '&') ID? / '(' bparam (',' bparam)* ')' / ID ':' operand? / ID ('=' operand)?
body: stmts ('rescue' rescue_types? ('=>' target_r)? ('then' / sep) stmts)* ('else' stmts)? ('ensure' stmts)?
rescue_types: '*'? ternary (',' nl '*'? ternary)*
ternary: operand
target_r: ID postfix*
primary: def / class / module / if / unless / while / for / case / begin / lambda / hash / array / '(' stmts ')' / NUM / STR+ / 'nil' / 'true' / 'false' / 'self' / '__FILE__' / '__LINE__' / '__method__' / '::' ID / ('return' / 'break' / 'next' / 'redo' / 'retry') (&cmd_start cmd_args)? / ('super' / 'yield') / '..' / '...' / ID
array: '[' nl (arg (nl ',' nl arg)* nl ','?)? nl ']'
hash: '{' nl (pair (nl ',' nl pair)* nl ','?)? nl '}'
pair: '**' e / NAME ':' nl (e / &(',' / '}' / NL)) / STR ':' nl e / e nl '=>' nl e
lambda: '->' (lparams / '(' dparams ')')? ('{' stmts '}' / 'do' body 'end')
lparams: dparam (',' dparam)*
@def: 'def' ((ID / 'self') '.')? def_name ('(' dparams ')' / (dparam (',' nl dparam)*)? &sep)? ('=' nl stmt / body 'end')
def_name: PNAME ('=' ADJ &('(' / ID))? / '[' ']' '='? / '+' / '-' / '*' / '/' / '%' / '==' / '===' / '=~' / '<=>' / '<<' / '>>' / '<' / '<=' / '>' / '>=' / '!' / '~' / '&' / '|' / '^' / '**' / STR
dparams: nl (dparam (nl ',' nl dparam)*)? nl
dparam: ('*' / '**' / '&') (ID / 'nil')? / '...' / '(' dparam (',' dparam)* ')' / ID ':' nl (!(',' / ')' / NL / '|') e)? / ID ('=' nl e)?
class: 'class' ('<<' e sep stmts 'end' / cpath ('<' e)? sep body 'end')
module: 'module' cpath sep stmts 'end'
cpath: '::'? ID ('::' ID)*
if: 'if' expr_stmt then stmts ('elsif' expr_stmt then stmts)* ('else' stmts)? 'end'
unless: 'unless' expr_stmt then stmts ('else' stmts)? 'end'
then: sep* 'then' / sep
while: ('while' / 'until') expr_stmt_nodo ('do' / sep) stmts 'end'
expr_stmt_nodo: e_nodo (('and' / 'or') e_nodo)*
e_nodo: operand_nodo (binop nl operand_nodo)*
operand_nodo: ('!' / '-' / 'not') operand_nodo / primary postfix_nodo*
postfix_nodo: ('.' / '&.') nl NAME args_adj? / '::' NAME args_adj? / args_adj / '[' index ']'
for: 'for' ID (',' ID)* 'in' e_nodo ('do' / sep) stmts 'end'
case: 'case' expr_stmt? sep* (('when' when_args then stmts)+ / ('in' pattern_c (('if' / 'unless') e)? then stmts)+) ('else' stmts)? 'end'
when_args: '*'? e (',' nl '*'? e)*
pattern_c: pattern_alt (',' pattern_alt)* ('=>' ID)?
pattern_alt: pattern_p ('|' pattern_p)*
pattern_p: '[' nl (pattern_item (nl ',' nl pattern_item)*)? nl ']' / '{' nl (pattern_pair (nl ',' nl pattern_pair)*)? nl '}' / pattern_pair (',' pattern_pair)* / '*' ID? / operand (('..' / '...') operand?)?
pattern_item: pattern_c
pattern_pair: '**' (ID / 'nil') / ID ':' pattern_alt?
begin: 'begin' body 'end'
"""

SOURCES = {
    "typescript": (TYPESCRIPT,),
    "javascript": (TYPESCRIPT, JAVASCRIPT),
    "java": (JAVA,),
    "csharp": (CSHARP,),
    "c": (C,),
    "cpp": (CPP,),
    "go": (GO,),
    "rust": (RUST,),
    "ruby": (RUBY,),
}
