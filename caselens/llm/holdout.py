"""Texts checked by hand: 0 is prose, 1 is a list, a table or junk.

``ANCHORS`` stand beside the weakly labelled sample in every training set, so that both kinds are always there. ``CALIBRATION``
texts only set the probability, ``MEASURED`` ones are only measured on; texts of a corpus that equal one of these two are kept
out of its training sample.
"""

HOLDOUT: list[tuple[int, str]] = [
    (0, "The patient was seen again after two weeks and reported that the pain had gone. On examination the abdomen was soft, and there was no sign of infection."),
    (0, "In our series of 214 patients, 31% had fever at the first visit. Treatment was started at 20 mg daily and later halved."),
    (0, "Would a second scan have changed the plan? Probably not."),
    (0, "She didn't tolerate the drug, so we've switched to another one since then, and it's been quiet."),
    (0, "It is often said that a dry cough points to the lung,\nyet this is not a rule. The differential is wide, and\nit includes several rare tumours that are easy to\noverlook at the first reading."),
    (0, "THE PATHOLOGIST DESCRIBED A SMALL NODULE WITH SCATTERED CELLS AND LITTLE STROMA. NOTHING MORE WAS DONE, AND THE PATIENT WAS SENT HOME ON THE FIFTH DAY."),
    (0, "the age at onset ranges from 12 to 40 years with a peak near 22 although small series describe younger patients so the plan was left as it stood"),
    (0, "By Contrast, This Pattern Tends To Spare The Liver And Does Not Enhance. The Surrounding Vessels Have To Be Checked In Every Case."),
    (0, "> After the operation the swelling had gone, but the\n> patient was still tired and had lost some weight by\n> the time that she was seen in the clinic again."),
    (0, "Q: What did the image show?\nA: It showed a ring of low signal near the margin, which is easy to mistake for a cyst.\nQ: And what was done next?\nA: A biopsy was taken, and it confirmed the first impression."),
    (0, "The lesion grew from 2.1 to 4.4 cm within six months and then stopped. Values at follow-up were:\n- zinc 12.1\n- copper 40.2\nBoth were within the usual range, and no further treatment was given to the patient."),
    (0, "- The patient was admitted on Monday with pain in the left flank\n- No family history was known, and he had never taken the drug\n- He was sent home on the ninth day and has been well ever since"),
    (0, "Der Patient klagte seit drei Wochen über Müdigkeit und nächtliches Schwitzen. Bei der Untersuchung war die Leber tastbar, aber nicht druckschmerzhaft."),
    (0, "Das Bild kann leicht mit einer Entzündung verwechselt werden."),
    (0, "La biopsie a confirmé l'hypothèse, sans signe de diffusion à distance. La famille a préféré attendre avant de décider d'une opération."),
    (0, "Cette image peut être confondue avec une simple inflammation."),
    (0, "La biopsia confirmó la sospecha y no hubo señales de extensión. El paciente refería cansancio y sudores nocturnos desde hacía dos semanas."),
    (0, "No está claro con qué frecuencia aparece esta forma en la población"),
    (0, "<p>The report was read by two people who did not know the outcome.</p>\n<p>They agreed in most of the cases, and where they did not, a third reader was asked.</p>"),
    (0, "A​ 40-year-old​ farmer​ who​ sells​ honey​ has​ noticed​ a​ rash​ on​ both​ hands​ that​ began​ after​ the​ fair."),
    (0, "Table 3 lists the findings that were seen most often. In more than half of the cases there was a filling defect, and in a third of them the wall was thick as well."),
    (0, "Note: the ward was told about the result at 14:30, and the drug was stopped on the same day."),
    (0, "See https://example.invalid/123 for the images. There is no agreement on how long the drug should be given in such cases."),
    (0, "Follow-up was uneventful.\n\n| item | value |\n|---|---|\n| urea | 4.1 |\n\nAs with every lesion of this kind, the surrounding vessels have to be checked, and the patient should be told that it may come back after some years."),
    (1, "item\tsite\tvalue\tunit\nzinc\trenal\t12.10\tmg/dL\ncopper\tbiliary\t88.02\tpg/mL\nurea\tgastric\t140.33\tU/L\nsodium\thepatic\t9.71\tmmol/L"),
    (1, "| item | site | value |\n|---|---|---|\n| zinc | renal | 12.10 |\n| copper | biliary | 88.02 |\n| urea | gastric | 140.33 |"),
    (1, "item,site,value,unit,flag\nzinc,renal,12.10,mg/dL,H\ncopper,biliary,88.02,pg/mL,\nurea,gastric,140.33,U/L,N"),
    (1, "<table>\n<tr><td>zinc</td><td>renal</td><td>12.10</td></tr>\n<tr><td>copper</td><td>biliary</td><td>88.02</td></tr>\n</table>"),
    (1, "Results 2:\nitem              site              value\nzinc              renal             12.10\ncopper            biliary           88.02\nurea              gastric           140.33"),
    (1, "Index of cases\n- fever\n- night sweats\n- renal stone\n- shortness of breath on stairs\n- copper\n- weight loss\n- femoral hernia"),
    (1, "1) jaw pain\n2) zinc\n3) renal cyst\n4) weight loss\n5) copper\n6) lactate\n7) a dry cough\n8) gastric ulcer"),
    (1, "a. fever.\nb. copper.\nc. renal cyst.\nd. clicking of the hip.\ne. lactate.\nf. pale stools.\ng. early satiety."),
    (1, "Equipment list: zinc · copper · femoral hernia · pale stools · lactate · renal · early satiety · gastric ulcer · urea · biliary stone"),
    (1, "Things to keep in mind renal cyst | fever | lactate | a dragging sensation | femoral | copper | pancreatic | early satiety"),
    (1, "renal cyst ........ 176\nearly satiety ........ 169\nfemoral hernia ........ 308\ncopper ........ 66\nof the hip ........ 220"),
    (1, "#renalcyst #zinc\n#morningheadache #gastric\n#copper\n#femoral #hepatic"),
    (1, "zinc = 82.93 pg/mL\ncopper: 199.64 mg/dL\ncortisol: 35.66 mmol/L\nurea: 218.19 IU/mL\nprolactin: 283.45 mg/dL"),
    (1, "49b0 9434 20c3 539a ee87 5601 7029 4208 6d12 3668 3d18 6898 178c 4eb9 8c42 ce4e 689b 5369 64c5 593e"),
    (1, "jzZBYAyM03HNWFkr3e0nmjInRwF6z7vr87ZU4qI8oPvFyIBpAXuorESp49G+4iQF32qwZy7ilaHbFGr765zL8rKcINDctwqykF28HDEAAHxMNPEa4G6BKEnSXHcIBvZ9H4=="),
    (1, '{"k0":{"t":"0x028314","v":[4,null,50]},"k1":{"t":"0x499469","v":[89,null,91]},"k2":{"t":"0x066482","v":[95,null,86]}}'),
    (1, "null null null null null null null null null null null null null null null null null null null null null null null null"),
    (1, "home next print > home next print > home next print > home next print > home next print > home next print > home next print"),
    (1, "accept all settings\naccept all settings\naccept all settings\naccept all settings\naccept all settings\naccept all settings"),
    (1, "2031-03-12T14:23:07 WARN viewer.net frame=4347 rc=6\n2031-03-05T07:50:07 INFO viewer.net frame=5305 rc=0\n2031-03-06T14:08:07 WARN viewer.net frame=12 rc=1"),
    (1, "s1sdkaxa6d.hkcue3qhj q4aq;rguhovu48kw8cx4b9ej6lkm4.1vy1q,8zqg  vj9wp,bczd991ut;4i4nl77lila6pgmvu;drs;p3  l2w4f .m,x;3hzd vmlu"),
    (1, "T1e nrd~oct sa|w eht~ pa1tien| in hte mo~rnign a1d g|ve ~im hte rdu|g, bt~u eh d1d nto ~eefl an|y be~ttre at a1l."),
    (1, "^~*=]<&■}=^/_%{/{}=-@-□->□}{%{**■□_&><#~-$■~/[^■>[_]!*□!^■&*>#@=<}[■□}_+$<□■+%&@}>#▒▒!}@+#]▒#□<$"),
    (1, "ïAmong ™thÅo¤se €gÃiven th½e dr™ug, ¤folÅl€owÂ-up ½a€t ¿21 ïwe¿eks ¢was™ žuÃnevÂeÃn¤tÅful™; thež va½lue hžad Åf¢a™ll€en."),
]

#: Texts of other make than the corpora's, written for measuring alone.
UNSEEN: list[tuple[int, str]] = [
    (0, "We drove up the valley before dawn, parked by the old mill and waited for the fog to lift. Nobody spoke much, since there was little to say."),
    (0, "Why does bread rise? The yeast eats the sugar in the dough, and the gas that it gives off is caught in a net of gluten."),
    (0, "Dear Ms Holm,\n\nThank you for your letter of the 3rd. I am sorry that the parcel came late, and I have asked the depot to look into it.\n\nYours,\nR. Vance"),
    (0, "The committee met twice. It agreed on the first point, put off the second, and could not find any money for the third."),
    (0, "i never thought id say this but the new keyboard is actually pretty good and i dont miss the old one at all so far"),
    (0, "Im Herbst ziehen die Kraniche über das Dorf, und die Kinder laufen hinaus, um sie zu zählen. Manchmal sind es mehr als hundert."),
    (0, "Quand il pleut, la place se vide en quelques minutes et les marchands rangent leurs étals sous les arcades, où ils attendent que cela passe."),
    (0, "Cuando terminó la obra, los vecinos salieron a la calle y brindaron con el albañil, que no sabía dónde meterse de la vergüenza."),
    (0, "To make the glue, stir the flour into cold water, then heat it slowly. When it thickens, take it off the stove and let it stand for an hour before you use it."),
    (0, "\"I won't,\" she said.\n\"You will,\" he said, and shut the door.\nThat was the last that the two of them spoke of it for years."),
    (0, "The bridge is 412 m long and carries two tracks. It was opened in 1931, closed in 1944 after the flood, and rebuilt by 1950 with steel from the same works."),
    (0, "Three things went wrong. First, the pump was too small for the well.\n- the spare one had been lent out\n- the fuses did not fit\nIn the end we carried the water by hand."),
    (1, "Monday 08:00-12:00\nTuesday 08:00-12:00\nWednesday closed\nThursday 14:00-18:00\nFriday 08:00-12:00\nSaturday closed"),
    (1, "milk\neggs\nflour\nbutter\nsalt\nbaking powder\nvanilla\nlemons"),
    (1, "name;city;age;score\nHolm;Oslo;41;7.5\nVance;Leeds;38;6.1\nKerr;Perth;52;9.0\nOtt;Bern;29;4.4"),
    (1, "def f(x):\n    return {k: v for k, v in x.items() if v}\n\nfor i in range(10):\n    print(f({i: i % 2}))"),
    (1, "JVBERi0xLjQKJcOkw7zDtsOfCjIgMCBvYmoKPDwvTGVuZ3RoIDMgMCBSL0ZpbHRlci9GbGF0ZURlY29kZT4+CnN0cmVhbQp4nD2OywoCMQxF9/mKu"),
    (1, "Home | About | Contact | Login | Register | Help | Terms | Privacy | Sitemap | Jobs | Press | Blog"),
    (1, "lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol lol"),
    (1, "C6H12O6 180.16\nC12H22O11 342.30\nNaCl 58.44\nH2SO4 98.08\nCaCO3 100.09\nKMnO4 158.03"),
    (1, "192.0.2.7 - - [04/Mar/2031:10:22:01] \"GET /a.png\" 200 5120\n192.0.2.9 - - [04/Mar/2031:10:22:02] \"GET /b.css\" 304 0\n192.0.2.7 - - [04/Mar/2031:10:22:05] \"GET /\" 200 913"),
    (1, "%%% ### @@@ &&& *** ((( ))) === +++ --- ~~~ ^^^ ::: ;;; <<< >>> ??? !!! /// ||| \\\\\\"),
    (1, "Chapter 1 ..... 3\nChapter 2 ..... 17\nChapter 3 ..... 41\nAppendix A ..... 88\nAppendix B ..... 93\nIndex ..... 101"),
    (1, "red, green, blue, cyan, magenta, yellow, black, white, orange, purple, brown, pink, grey, olive, teal, navy"),
]
ANCHORS, CALIBRATION, MEASURED = HOLDOUT[::3], HOLDOUT[1::3], HOLDOUT[2::3] + UNSEEN
