"""Digests of whole licence texts, made by licenses.known_texts: (license, digest, canonical first block, blocks)."""

DIGESTS = (
    ("Apache-2.0", "20934cdcf7ddfde1db21bef6120bfe76fc2c75af86ff5846aef5e63769e5f5f2", "apache license version 2 january 2004 https www apache org licenses", 33),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "creative commons legal code", 13),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71", "gnu free documentation license version 1 2 november 2002", 57),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6", "gnu free documentation license version 1 3 3 november 2008", 67),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "gnu general public license version 1 february 1989", 50),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "gnu general public license version 2 june 1991", 59),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "gnu general public license version 3 29 june 2007", 122),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "gnu library general public license version 2 june 1991", 83),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "gnu lesser general public license version 2 1 february 1999", 85),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu lesser general public license version 3 29 june 2007", 37),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1", "mozilla public license version 1 1", 73),
    ("MPL-2.0", "ccb2452a3828a0c9f754214e184af2652be8efce4805cb9838cd64e558fcb9ef", "mozilla public license version 2", 83),
)
