x860