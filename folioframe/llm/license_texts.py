"""Licence notices that are looked for: (name, licence, text, key phrases that must all be there)."""

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
    "Software Foundation, either version {n} of the License, or (at your option) any later version."
)
_GPL_ONLY = _GPL.partition(", either")[0] + ", version {n}."
_CC = "This work is licensed under a Creative Commons {name} 4.0 International License."

TEMPLATES: list[tuple[str, str, str, list[str]]] = [
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    (
        "apache-notice",
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ["apache license version 2 0", "except in compliance with the license"],
    ),
    ("mit-line", "MIT", "Released under the MIT License", ["mit license"]),
    (
        "mit-notice",
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software. " + _WARRANTY,
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl3-notice", "GPL-3.0", _GPL.format(name="General Public License", n=3), ["the gnu general public license as published", "either version 3 of the license"]),
    ("gpl2-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl2-notice", "GPL-2.0", _GPL.format(name="General Public License", n=2), ["the gnu general public license as published", "either version 2 of the license"]),
    ("lgpl-notice", "LGPL-3.0", _GPL.format(name="Lesser General Public License", n=3), ["the gnu lesser general public license as published", "either version 3 of the license"]),
    ("lgpl-version", "LGPL-3.0", _GPL_ONLY.format(name="Lesser General Public License", n=3), ["the gnu lesser general public license as published by the free software foundation version 3"]),
    ("lgpl21-notice", "LGPL-2.1", _GPL.format(name="Lesser General Public License", n=2.1), ["the gnu lesser general public license as published", "either version 2 1 of the license"]),
    ("lgpl21-version", "LGPL-2.1", _GPL_ONLY.format(name="Lesser General Public License", n=2.1), ["the gnu lesser general public license as published by the free software foundation version 2 1"]),
    ("lgpl2-notice", "LGPL-2.0", _GPL.format(name="Lesser General Public License", n=2), ["the gnu lesser general public license as published", "either version 2 of the license"]),
    ("agpl-notice", "AGPL-3.0", _GPL.format(name="Affero General Public License", n=3), ["the gnu affero general public license as published", "either version 3 of the license"]),
    ("agpl-version", "AGPL-3.0", _GPL_ONLY.format(name="Affero General Public License", n=3), ["the gnu affero general public license as published by the free software foundation version 3"]),
    (
        "bsd-notice",
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["redistribution and use in source and binary forms", "endorse or promote products"],
    ),
    ("bsd-line", "BSD-3-Clause", "Licensed under the BSD 3-Clause License", ["bsd 3 clause"]),
    (
        "isc-notice",
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        ["with or without fee is hereby granted"],
    ),
    (
        "mpl-notice",
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license v 2 0"],
    ),
    ("ccby-notice", "CC-BY-4.0", _CC.format(name="Attribution"), ["creative commons attribution 4 0"]),
    ("ccbysa-notice", "CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike"), ["creative commons attribution sharealike 4 0"]),
    ("ccbync-notice", "CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial"), ["creative commons attribution noncommercial 4 0"]),
    ("ccby-line", "CC-BY-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("ccbysa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("ccbync-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc0-line", "CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0"]),
    (
        "unlicense-notice",
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software",
        ["free and unencumbered software"],
    ),
    ("reserved-line", "Proprietary", "All rights reserved", ["all rights reserved"]),
]
