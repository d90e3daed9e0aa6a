x617