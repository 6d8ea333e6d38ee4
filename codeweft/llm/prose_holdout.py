"""A hand-written and hand-checked holdout for calibrating the prose model: (text, is prose)."""

HOLDOUT = [
    ("The import ran twice last night, so every invoice of that branch shows up with two lines. We removed the second one by hand and will add a lock before the next release.", 1),
    ("I think we should keep the old name for now. It is printed on the forms, and the people at the desk are used to it.", 1),
    ("nobody knows why the list is empty on mondays but it has something to do with the cache that is filled on sunday evening", 1),
    ("> When you open the page for the first time, it takes about ten seconds.\n> After that it is quick, because the result is kept for an hour.", 1),
    ("# What this service does\n\nIt reads the orders that came in during the day and sends one message to each customer. If a message cannot be delivered, it is tried again in the morning.", 1),
    ("Note that the job must not run before the nightly import has ended, since it relies on the codes that are written there.\n\n    php desk jobs:run totals\n\nAfterwards the numbers on the dashboard should agree with those in the report.", 1),
    ("A: have you seen the error on the order page?\nB: yes, it comes from the new policy. I will fix it after lunch.\nA: thanks, then I will tell the others to wait.", 1),
    ("Wir haben die Spalte nicht gelöscht, weil sie noch von einer alten Auswertung gelesen wird. Im nächsten Monat fällt sie dann weg.", 1),
    ("Die Liste ist nach dem Datum sortiert und nicht nach dem Namen, auch wenn das auf der Seite anders steht.", 1),
    ("La page affiche toujours la même liste, parce que le cache n'est vidé que pendant la nuit. Nous avons donc ajouté un bouton pour le faire à la main.", 1),
    ("El informe no se genera cuando la tabla está vacía, y por eso la página muestra los datos del mes pasado. Lo vamos a cambiar en la próxima versión.", 1),
    ("Мы не знаем, почему эта таблица пуста, но отчёт за месяц из-за этого не строится. После обновления всё должно работать как раньше.", 1),
    ("Thanks, that did it.", 1),
    ("please have a look at the second part of the form. it says that the field is required, but you can save without it and then the report is wrong", 1),
    ("// This class was written when there was only one warehouse, and that is the reason\n// why it does not ask for a branch. We keep it because the import still uses it,\n// but new code should go through the gateway instead.", 1),
    ("Neither of the two listeners is queued, which means that the request waits for both of them before the answer is sent. That is fine for a few rows but not for the whole month.", 1),
    ("The first step copies the rows,\nthe second one sorts them by date,\nand the last one writes them to the\nfile that the other team picks up.", 1),
    ("Before you change the rate, ask the people who have to explain it on the phone. They were not told the last time, and it took them a week to find out.", 1),
    ("There is a table below, but most of what you need to know is in this text. The values are in cents, and they are rounded only at the very end. If a value is missing, the one of the month before is taken.\n\n| month | total |\n|---|---|\n| 1 | 20 |", 1),
    ("On the other hand, it would be easier to start again from the event, because then nobody has to care about the order in which the rows arrive.", 1),
    ("table of the a is before on we written not been rows and has month it import the old the by to for the in that sorted who a", 0),
    ("keni si tsil eht yhw swonk ydobon tub yadnom no gnihtemos htiw od ot sah ti dna ehcac eht", 0),
    ("the of and the list a to the name in the report was is for on it not the the page from rows with at an by orders one", 0),
    ("| id | name | state |\n|---|---|---|\n| 1 | alpha | open |\n| 2 | beta | held |\n| 3 | gamma | open |", 0),
    ("id;name;amount\n1;alpha;20.50\n2;beta;17.25\n3;gamma;99.10\n4;delta;12.00", 0),
    ("- add rate limit\n- remove old column\n- fix export\n- rename gateway\n- update lock file\n- bump version", 0),
    ("<?php\n\nclass Order extends Model\n{\n    protected $table = 'orders';\n\n    public function total(): int\n    {\n        return $this->lines->sum('amount');\n    }\n}", 0),
    ("function total(rows) {\n  return rows.map((x) => x.amount * 100).reduce((a, b) => a + b, 0);\n}\nconst t = total(data);\nconsole.log(t);", 0),
    ("[2024-01-02 10:11:12] main.ERROR: timeout {\"id\":12}\n[2024-01-02 10:11:13] main.INFO: retry {\"id\":12}\n[2024-01-02 10:11:15] main.ERROR: timeout {\"id\":13}", 0),
    ("#0 /srv/app/Order.php(12): Order->total()\n#1 /srv/app/Kernel.php(80): Kernel->run()\n#2 /srv/index.php(9): Kernel->handle()\n#3 {main}", 0),
    ("{\"name\": \"alpha\", \"state\": \"open\", \"rows\": [1, 2, 3], \"next\": null, \"ok\": true}", 0),
    ("Home | Orders | Reports | Settings | Help | Log out | Home | Orders | Reports | Settings | Help", 0),
    ("Buy now Buy now Buy now Buy now Buy now Buy now Buy now Buy now Buy now Buy now Buy now", 0),
    ("order branch rate sealed open import total ledger amount state label channel report page quota member ticket", 0),
    ("SELECT o.id, o.total FROM orders o JOIN lines l ON l.order_id = o.id WHERE o.state = 'open' GROUP BY o.id, o.total ORDER BY o.total DESC;", 0),
    ("aGVsbG8gd29ybGQgdGhpcyBpcyBhIGJsb2I=\nQUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=\nMDEyMzQ1Njc4OWFiY2RlZg==", 0),
    ("/orders/{id}\n/orders/{id}/lines\n/branches/{branch}/rates\n/reports/month\n/reports/year", 0),
    ("## 2.1.0\n- Added: order export (#12)\n- Fixed: rate rounding (#15)\n\n## 2.0.9\n- Removed: old gateway (#9)\n- Fixed: label (#8)", 0),
    ("ist die und der nicht nach Spalte wird das von auch eine im gelesen wir haben den Monat in noch auf zu Tabelle dem", 0),
    ("est le la que pas une dans nous avons page la de les liste cache pour nuit et toujours pendant même est", 0),
    ("Name: Alpha\nState: open\nOwner: beta\nTotal: 20\nBranch: north\nRate: 7\nState: held\nOwner: gamma\nTotal: 11", 0),
    ("%%$#@!*&^ 12 ~~ || ## 88 {{ }} <> == ++ 77 && ^^ 00 ;; :: ,, .. 31 !! ?? // \\\\ 42", 0),
    ("1) order\n2) branch\n3) rate\n4) ledger\n5) ticket\n6) report\n7) member\n8) quota", 0),
    ("[x] export orders\n[ ] check rates\n[x] rename column\n[ ] drop index\n[ ] merge branch", 0),
]
