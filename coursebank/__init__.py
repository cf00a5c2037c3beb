"""CourseBank: question-bank analytics as Spark DataFrame jobs."""
