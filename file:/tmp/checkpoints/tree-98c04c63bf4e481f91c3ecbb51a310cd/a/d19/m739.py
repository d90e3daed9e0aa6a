x739