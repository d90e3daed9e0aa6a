x193