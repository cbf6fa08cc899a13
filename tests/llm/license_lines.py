"""Header lines and sentences about licences, written by hand. Many headers hold a template whole, as these are the usual statements."""

HEADERS = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
This software is distributed under the Apache License 2.0, see LICENSE.txt
# SPDX-License-Identifier: Apache-2.0
The library is released under the Apache License, Version 2.0.
Kestrel is available under the Apache 2.0 license.
License: Apache-2.0
All code here is licensed under the Apache License 2.0 unless stated otherwise.""",
    "mit": """// SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction
This package is MIT licensed.
Distributed under the MIT License. See LICENSE for more information.
Copyright (c) 2014 Jane Doe. Released under the MIT license.
The gem is available as open source under the terms of the MIT License.
License: MIT
* Licensed under the MIT license, see the file COPYING in the root.
Dialog widgets, licensed under MIT.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
/* SPDX-License-Identifier: BSD-3-Clause */
// SPDX-License-Identifier: BSD-2-Clause
This module is released under the BSD license.
Distributed under the 3-Clause BSD License, see accompanying file.
The parser is licensed under the BSD 2-Clause License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
# SPDX-License-Identifier: GPL-2.0-only
# SPDX-License-Identifier: GPL-3.0-or-later
Licensed under the GPL, version 2 or later.
This plugin is released under the GNU General Public License v2.0.
Distributed under the GNU GPL version 3, see COPYING.
License: GPL-3.0
Emblem is licensed under the GPLv3.
Kernel modules are distributed under the terms of the GNU General Public License, version 2.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License
// SPDX-License-Identifier: LGPL-2.1-or-later
The toolkit is licensed under the LGPL, version 3.
Licensed under the GNU Lesser General Public License v3.0.
Released under the GNU Lesser General Public License, version 2.1 or newer.
/* SPDX-License-Identifier: LGPL-3.0-only */""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation.
// SPDX-License-Identifier: AGPL-3.0-only
The server is licensed under the GNU Affero General Public License v3.
Released under the AGPL, version 3.
Licensed under the AGPLv3, see LICENSE.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
// SPDX-License-Identifier: MPL-2.0
The add-on is released under the Mozilla Public License 2.0.
Licensed under the MPL 2.0, see LICENSE.
License: MPL-2.0""",
    "epl": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution
* SPDX-License-Identifier: EPL-2.0
The editor is licensed under the Eclipse Public License, version 2.0.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted
// SPDX-License-Identifier: ISC
Glob matching, released under the ISC license.
The daemon is distributed under the ISC License.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions
// SPDX-License-Identifier: Zlib
The codec is licensed under the zlib license.""",
    "bsl-1.0": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
// SPDX-License-Identifier: BSL-1.0
Use, modification and distribution are subject to the Boost Software License, Version 1.0.
The headers are licensed under the Boost Software License 1.0.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
// SPDX-License-Identifier: Unlicense
These scripts are released under the Unlicense.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License.
The figures are licensed under CC BY 4.0.
Text is available under CC BY 4.0, images as marked.
SPDX-License-Identifier: CC-BY-4.0
Licensed under the Creative Commons Attribution 4.0 license.""",
    "cc-by-sa": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Content is licensed under CC BY-SA 4.0.
SPDX-License-Identifier: CC-BY-SA-4.0
The manual is licensed under a Creative Commons Attribution-ShareAlike 4.0 license.""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Slides are licensed under CC BY-NC 4.0.
SPDX-License-Identifier: CC-BY-NC-4.0""",
    "cc0": """The data set is dedicated to the public domain under CC0.
SPDX-License-Identifier: CC0-1.0
Sample images are released under CC0 1.0 Universal.""",
    "proprietary": """Copyright 2011 Northwind Tools. All rights reserved.
Copyright (C) Fable Works Ltd 2003-2009. All Rights Reserved.
Proprietary and confidential. Unauthorized copying of this file is strictly prohibited. Copyright Arden Inc, all rights reserved.
(c) Copyright 1999 Quill Press, all rights reserved""",
}
PROSE = """Is software released under the MIT license better than the rest?
is software released under the MIT license better than
Which of these libraries are licensed under the Apache License, Version 2.0?
I never understood what the GNU General Public License asks of a company.
Her lecture on the Mozilla Public License lasted two hours.
Do I have to publish my changes if the tool is licensed under the GPL?
The survey found that most packages released under the MIT license have one maintainer.
He compared the Apache License with the BSD license in a long essay.
My cousin works at MIT and has a fishing license.
The committee voted against releasing the code under the GPL.
Whether a program licensed under the GPL can link to it is disputed.
A lawyer explained why the LGPL differs from the GPL.
They argued for weeks about moving from the MIT license to the AGPL.
What is the difference between CC BY 4.0 and CC BY-SA 4.0?
The Eclipse Public License was written by a foundation.
Why would anyone release a book under a Creative Commons license?
Older versions were licensed under terms that nobody remembers.
Her driver's license expired in May.
The state granted the physician a license to practice.
Permission was granted to build the barn.
He asked for permission to use the hall for any purpose.
The public domain is a concept with a long history.
The general public was not admitted.
An Apache helicopter landed near the bridge.
The eclipse was visible to the public for two minutes.
A boost in software sales was noted in March.
We license our songs to radio stations.
The license plate was found in the river.
Copyright law changed in 1976.
The museum reserved all rights to the photographs of the bird.
All seats are reserved and all rights of way are open.
The artist reserves the copyright of the painting.
Confidential papers were copied without authority.
Is the copy of this software that I bought genuine?
Free of charge, to any person who asks, we give a map.
Redistribution of land in source regions was permitted.
Use in binary form was rare before the war.
You may not use this door except in an emergency.
Mozilla held a meeting about fonts.
Zlib compresses the stream before it is sent.
The ISC league plays on Sunday.
BSD systems start quickly.
The creative commons room is on the second floor.
Attribution of the painting to the master is disputed.
Non-commercial use of the pool is free on weekdays.
The GNU is a large antelope.
Gnu herds move to the north in spring.
Version 2.0 of the plan is under review.
The agreement is subject to the terms of the treaty.
The work is under way and the terms are public.
This program is about free time and modern life.
You can redistribute the chairs and modify the room under the terms of the lease.
The accompanying materials are available at the desk.
The library is free and open to all people until nine.
Without any express train the trip takes a day.
In no event will the authors sign books after ten.
A warranty is provided by the seller for a year.
The files are in the second drawer.
What does SPDX stand for?
How many repositories carry a file that says they are MIT licensed?
If the font were licensed under the Apache License, we could ship it.
Nobody knows who wrote the zlib license.
The term unlicense sounds odd to lawyers.
He doubts that the Boost license covers examples.
Can a poem be dedicated to the public domain under CC0?
The history of the BSD license begins in Berkeley.
Many readers confuse the ISC license with the MIT license.
The court did not say that the GPL is a contract.
We once thought about the Affero General Public License for our server.
Critics of the Mozilla Public License say that it is long.
Students were asked to read the GNU Lesser General Public License.
A blog post ranks the Apache License first among permissive licenses.
The vendor refused to say if its fork was released under the GPL.
Can software that is proprietary and confidential be audited?
The price of a software license rose by a third.
Three firms bought a license for the new drug.
The license server is down again.
Her marriage license was signed by the mayor.
The city revoked the bar's liquor license.
A poet takes license with the facts.
The bakery sells bread, and its recipe is a secret.
It rained all night and the road was closed.
The patent office granted the claim.
Under the old law, fishing required a permit.
Our work is licensed by the city and inspected each year.
The taxi company is licensed under state rules.
The pharmacy was licensed under the act of 1968.
The album was released under the name of the singer.
The film was released under the title of the novel in 1954.
The prisoner was released under strict terms.
The firm distributed leaflets under the bridge.
Water is available under the sink.
The team at MIT released a paper on bats.
The MIT choir sings in the chapel.
Eclipses are subject to the laws of motion.
Source code was printed in the magazine.
The form is subject to change.
Identifiers are listed in the index.
A clause of the contract was void.
The two-clause sentence is easy to parse.
The commercial says that the offer ends soon.
International flights leave from the new hall.""".split("\n")
