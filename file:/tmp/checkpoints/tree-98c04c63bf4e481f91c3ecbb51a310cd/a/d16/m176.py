x176