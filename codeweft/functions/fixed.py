"""Names and words that decide results and are what they are."""

from __future__ import annotations

#: Parts of a path that say nothing about a feature.
NOISE = (
    "api", "v1", "v2", "v3", "v4", "web", "admin", "dashboard",
    "app", "index", "list", "detail", "show", "create", "store",
    "edit", "update", "delete", "destroy",
)

#: Scalar and pseudo types that name no class.
SCALARS = (
    "int", "integer", "float", "double", "string", "bool", "boolean",
    "null", "void", "never", "array", "callable", "iterable", "mixed",
    "object", "resource", "self", "static", "parent", "$this",
    "true", "false",
)

#: Database type -> common name.
DB_TYPES = {
    "tinyint": "tinyinteger", "smallint": "smallinteger", "mediumint": "integer", "int": "integer", "bigint": "biginteger",
    "float": "float", "double": "double", "decimal": "decimal", "numeric": "decimal",
    "char": "string", "varchar": "string", "tinytext": "text", "text": "text", "mediumtext": "text", "longtext": "text",
    "tinyblob": "binary", "blob": "binary", "mediumblob": "binary", "longblob": "binary", "binary": "binary", "varbinary": "binary",
    "date": "date", "datetime": "datetime", "timestamp": "timestamp", "time": "time", "year": "year",
    "json": "json", "enum": "enum", "set": "set", "bit": "boolean", "bool": "boolean", "boolean": "boolean", "uuid": "string",
}

#: Prefix of a path -> role; the first that fits holds.
ROLE_PREFIXES = (
    ("app/Models/", "model"), ("app/Http/Controllers/", "controller"), ("app/Http/Middleware/", "middleware"), ("app/Jobs/", "job"), ("app/Events/", "event"), ("app/Listeners/", "listener"),
    ("app/Policies/", "policy"), ("app/Http/Requests/", "request"), ("app/Http/Resources/", "resource"), ("app/Notifications/", "notification"), ("app/Observers/", "observer"),
    ("app/Console/Commands/", "command"), ("app/Providers/", "provider"), ("database/factories/", "factory"), ("database/seeders/", "seeder"), ("database/migrations/", "migration"), ("routes/", "route_file"),
)

#: Calls that say nothing about the flow of a program.
PLAIN_CALLS = (
    "array_map array_filter array_reduce array_merge array_push array_pop array_shift array_unshift array_keys array_values "
    "array_key_exists array_search array_slice array_splice array_unique array_flip array_combine array_chunk array_diff "
    "array_intersect array_pad array_column array_fill count sizeof strlen str_len strtolower strtoupper substr strpos strrpos "
    "str_replace str_contains str_starts_with str_ends_with trim ltrim rtrim explode implode join sprintf printf intval floatval "
    "strval boolval is_null is_array is_string is_int is_float is_bool is_object isset empty unset in_array json_encode json_decode "
    "preg_match preg_replace preg_split preg_match_all date time strtotime mktime microtime class_exists method_exists "
    "property_exists function_exists get_class get_parent_class instanceof call_user_func call_user_func_array throw new echo print "
    "die exit app config env route url redirect response request session view trans __ trans_choice abort abort_if abort_unless back "
    "collect data_get data_set optional rescue tap value with filled blank class_basename str now today yesterday tomorrow dispatch "
    "broadcast event info logger report report_if throw_if throw_unless validator"
).split()

#: Short name that stands for a service -> the class behind it.
FACADES = {
    "Cache": "Illuminate\\Cache\\Repository", "Config": "Illuminate\\Config\\Repository", "DB": "Illuminate\\Database\\DatabaseManager", "Event": "Illuminate\\Events\\Dispatcher",
    "Gate": "Illuminate\\Auth\\Access\\Gate", "Hash": "Illuminate\\Hashing\\HashManager", "Http": "Illuminate\\Http\\Client\\Factory", "Log": "Illuminate\\Log\\LogManager",
    "Mail": "Illuminate\\Mail\\Mailer", "Notification": "Illuminate\\Notifications\\ChannelManager", "Queue": "Illuminate\\Queue\\QueueManager", "Redis": "Illuminate\\Redis\\RedisManager",
    "Route": "Illuminate\\Routing\\Router", "Schema": "Illuminate\\Database\\Schema\\Builder", "Session": "Illuminate\\Session\\SessionManager", "Storage": "Illuminate\\Filesystem\\FilesystemManager",
    "URL": "Illuminate\\Routing\\UrlGenerator", "Validator": "Illuminate\\Validation\\Factory", "View": "Illuminate\\View\\Factory", "Auth": "Illuminate\\Auth\\AuthManager",
    "Bus": "Illuminate\\Contracts\\Bus\\Dispatcher", "Broadcast": "Illuminate\\Broadcasting\\BroadcastManager", "Crypt": "Illuminate\\Encryption\\Encrypter", "File": "Illuminate\\Filesystem\\Filesystem",
    "Artisan": "Illuminate\\Contracts\\Console\\Kernel", "Response": "Illuminate\\Routing\\ResponseFactory", "Request": "Illuminate\\Http\\Request", "Cookie": "Illuminate\\Cookie\\CookieJar",
    "Redirect": "Illuminate\\Routing\\Redirector",
}

#: Name spaces whose symbols a short name means first.
PREFERRED_SPACES = ("App\\Models\\", "App\\Services\\", "App\\Http\\Controllers\\")

#: Static receivers whose dispatch call dispatches something else.
DISPATCH_FACADES = ("event", "bus", "queue", "job", "mail", "notification", "dispatch")

#: Roles of the files whose methods are searched for costly queries, and for races.
RISK_ROLES = ("controller", "service", "repository", "model")
RACE_ROLES = ("model", "controller", "service", "job")

#: Parts of the names of columns that hold secrets, and of those that only look so.
SENSITIVE = (
    "card_number", "card_last_four", "card_last4", "card_brand", "name_on_card", "payment_method_id", "client_secret", "stripe_token", "stripetoken",
    "access_token", "secret_key", "private_key", "api_key", "card_name", "cvv", "pan_number",
)
NOT_SENSITIVE = ("card_title", "enable_card", "card_id", "company_name", "company_logo", "company_address", "rate_", "expected_", "occupancy", "enable_", "token_2fa")

#: Names of methods that the framework calls, and roles whose methods it all calls.
EXEMPT_METHODS = (
    "handle boot register up down run definition schedule broadcastOn broadcastWith broadcastAs via toMail toArray build __construct __call __callStatic __get __set "
    "__toString __invoke __destruct __clone __sleep __wakeup __serialize __unserialize __isset __unset __debugInfo"
).split()
EXEMPT_ROLES = ("policy", "observer", "request", "resource")

#: Calls on a model that declare a relation.
RELATION_CALLS = "hasOne hasMany belongsTo belongsToMany hasOneThrough hasManyThrough morphOne morphMany morphTo morphToMany morphedByMany hasOneOfMany hasManyOfMany through".split()

#: Short name of a parent class -> role, for files whose place tells none.
PARENT_ROLES = {
    "Model": "model", "Authenticatable": "model", "Pivot": "model", "Controller": "controller", "BaseController": "controller", "FormRequest": "request", "Resource": "resource", "JsonResource": "resource",
    "ResourceCollection": "resource", "Notification": "notification", "Mailable": "mailable", "Job": "job", "Queueable": "job", "Event": "event", "Listener": "listener", "Policy": "policy", "Observer": "observer",
    "Command": "command", "ServiceProvider": "provider", "Factory": "factory", "Seeder": "seeder", "DatabaseSeeder": "seeder", "Middleware": "middleware",
}
