x437