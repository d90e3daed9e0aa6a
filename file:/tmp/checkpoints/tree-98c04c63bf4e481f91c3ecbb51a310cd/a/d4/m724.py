x724