x678