"""A few hand-written texts that every training sample gets, so that it always has both classes: (text, is prose)."""

SEED = [
    ("We moved the nightly export to a later hour because the backup was still running. Since then nobody has complained about missing rows.", 1),
    ("The form asks for a date, but it also takes a week number. That is on purpose and should stay as it is until the new screen is ready.", 1),
    ("please do not close this yet, the second part of the fix is not merged and the customer is still waiting for an answer", 1),
    ("When a parcel comes back, the clerk scans it again and the system opens a new case. The old case is kept so that the history can be read later.", 1),
    ("Der Bericht wird jeden Morgen an die Filialen verschickt. Wenn eine Filiale geschlossen ist, bleibt er bis zum nächsten Tag liegen.", 1),
    ("Le contrat est signé par les deux parties avant la livraison. Une copie est gardée dans le dossier du client pendant dix ans.", 1),
    ("El pago se confirma cuando el banco envía el aviso. Hasta entonces la reserva queda abierta y se puede cambiar sin coste.", 1),
    ("I tried it on my machine and it works, so the reason must be in the settings of the server. Can you look at the log of last night?", 1),
    ("id;name;amount;state\n1;desk;12.50;open\n2;lamp;8.00;held\n3;chair;40.10;open\n4;shelf;99.99;void\n5;rug;15.20;held", 0),
    ("[2024-03-01 10:00:01] INFO job=17 state=done ms=120\n[2024-03-01 10:00:02] WARN job=18 state=late ms=900\n[2024-03-01 10:00:09] INFO job=19 state=done ms=80", 0),
    ("foreach ($rows as $row) {\n    $total += $row->amount * 2;\n    if ($total > 10) { break; }\n}\nreturn $this->save($total);", 0),
    ("| key | value |\n|---|---|\n| host | 10.0.0.1 |\n| port | 8080 |\n| mode | fast |\n| retry | 3 |", 0),
    ("{\"a\": [1, 2, 3], \"b\": {\"c\": null, \"d\": \"x\"}, \"e\": [{\"f\": 1.5}, {\"f\": 2.5}, {\"f\": 3.5}]}", 0),
    ("home home home home home home about about about contact contact contact login login login home about contact", 0),
    ("- bolts\n- nuts\n- screws\n- washers\n- nails\n- hinges\n- brackets\n- clamps\n- hooks\n- wires", 0),
    ("lorem xqz vrt plk mnb wsx edc rfv tgb yhn ujm ikl qaz wsx plm okn ijb uhv ygc tfx rdz", 0),
]
