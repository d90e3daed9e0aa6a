x754