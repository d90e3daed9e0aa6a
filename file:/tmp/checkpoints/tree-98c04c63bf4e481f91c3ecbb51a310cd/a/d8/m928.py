x928